"""Sealing of columns: AES-256-GCM with the row's id as associated data."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scrypt parameters, kept in the store's header.
KDF = {"name": "scrypt", "n": 16384, "r": 8, "p": 1}


def derive_key(passphrase: str, salt: bytes, kdf: dict = KDF) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=kdf["n"], r=kdf["r"], p=kdf["p"], dklen=32)


def seal(value: Column, key: bytes, aad: Column) -> Column:
    """Base64 text of nonce, ciphertext and tag; Spark draws the nonce.  Null stays null."""
    return F.base64(F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad))


def open_sealed(value: Column, key: bytes, aad: Column) -> Column:
    """The value, or null where key or associated data don't fit."""
    return F.try_aes_decrypt(F.unbase64(value), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
