"""Personal data (operator 4).

Base spans are fixed patterns.  The method, a semi-Markov conditional random field, adds
spans that the patterns miss (spaced or bracketed e-mail addresses, telephone numbers
without a plus, spaced card or IP numbers): a segment of up to MAX_TOKENS tokens is scored
as a whole by features of its text and context, and a dynamic program over segments of
bounded length chooses boundaries and types together.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memstore.llm.common import fields, numbered, slices, tidy

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A part of an address takes all its digits in any match, so none starts within a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    """Whether a part of an address is 255 at most, however many zeros it begins with."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Pattern matches by start, then kind; a match that fails its test is dropped, without retries."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # a local part is all its characters before the @, back to the last match
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(octet(p) for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- the segment model ----------------------------------------------------------

MAX_TOKENS, SEGMENT = 15, 80
#: No kind has more digits: 19 of a card, or zeros before them.
MOST_DIGITS = 24
#: Least posterior log odds against leaving the tokens outside, for a span to be added.
MARGIN = 1.0
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\w")
_AT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\sat\s|\s@\s|@", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*dot\s*[\])}>]\s*|\sdot\s|\s\.\s|\.", re.I)
_MARKS = re.compile(r"[\[({<]\s*(?:at|dot)\s*[\])}>]|\sat\s|\sdot\s|\s@\s", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,6}\Z")
_BRACKETS = re.compile(r"[\[({<]")
_ODD_MARKS = re.compile(r"[^\w\s().@\[\]-]")
_AT_WORD = re.compile(r"\s[Aa][Tt]\s")
_DIGIT_TRIGGER = re.compile(r"[0-9][0-9 ()./\-]{5,}[0-9]")
_TRIGGER = re.compile(r"[0-9][0-9 ()./\-]{5,}[0-9]|[0-9]{1,3}(?:(?: ?\. ?| dot )[0-9]{1,3}){3}|\w\s*(?:[\[({<]\s*at\s*[\])}>]|\s(?:at|@)\s)\s*\w[^\n]{0,60}?(?:[\[({<]\s*dot\s*[\])}>]|\sdot\s|\s\.\s|\.)", re.I)
_PHONE_SHAPE = re.compile(r"(?:00?1?[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}\Z")
#: Groups of two to five digits, and one of up to eight after a leading zero or country code.
_GROUPS_SHAPE = re.compile(r"(?:\(?0[0-9]{1,4}\)?[ ./-]{1,3}[0-9]{2,8}|(?:00)?[1-9][0-9]{0,2}(?:[ ./-]\(?0?[0-9]{1,4}\)?)(?:[ ./-][0-9]{2,5}){1,4}|\(?0[0-9]{1,4}\)?(?:[ ./-]{1,3}[0-9]{2,5}){2,4})\Z")
_DATE_SHAPE = re.compile(r"(?:[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2})")
_CARD_SHAPE = re.compile(r"[0-9]{4}([ .-]+[0-9]{4}){2}[ .-]+[0-9]{2,7}\Z")
_IP_SHAPE = re.compile(r"[0-9]{1,3}( ?[.] ?| dot )[0-9]{1,3}( ?[.] ?| dot )[0-9]{1,3}( ?[.] ?| dot )[0-9]{1,3}\Z", re.I)
_CUES = {"email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "call", "tel", "mobil", "fax", "ring", "ruf", "dial", "text me", "handy", "rufnummer", "número", "numéro", "whatsapp")}
FEATURE_NAMES = ("bias", "address", "at_and_dot", "phone_shape", "card_shape", "luhn", "ip_shape", "octets", "digits_7_9", "digits_10_13", "digits_14_19", "other_digits", "letters", "odd_marks", "glued", "cue", "long", "one_token", "groups_shape", "date", "cue_and_groups", "trunk_zero")
#: Shapes of which a candidate has one.
SHAPES = frozenset((1, 3, 4, 5, 6, 18))


def plain_address(s: str) -> str:
    return _DOT.sub(".", _AT.sub("@", s))


def plain_features(text: str, s: int, e: int, tokens: int) -> tuple[list[int], list[int]]:
    """Indices of the features of text[s:e] that hold for any kind: those before the cue, and those after it."""
    seg = text[s:e]
    digits = _NOT_DIGIT.sub("", seg)
    n = len(digits)
    marks = bool(_MARKS.search(seg))
    address = marks and bool(_ADDRESS.match(plain_address(seg)))
    f = [0]
    f += [1] * address + [2] * (marks and "dot" in seg.lower())
    f += [3] * bool(_PHONE_SHAPE.match(seg)) + [4] * bool(_CARD_SHAPE.match(seg))
    f += [5] * (14 <= n <= 19 and luhn(digits))
    ip = bool(_IP_SHAPE.match(seg))
    f += [6] * ip + [7] * (ip and all(octet(p) for p in re.findall(r"[0-9]+", seg)))
    f.append(8 if 7 <= n <= 9 else 9 if 10 <= n <= 13 else 10 if 14 <= n <= 19 else 11)
    f += [12] * (not address and any(c.isalpha() for c in seg) and not ip)
    f += [13] * bool(_ODD_MARKS.search(seg))
    f += [14] * bool((s and (text[s - 1].isalnum() or text[s - 1] in "=\"'#/_+$.-")) or (e < len(text) and (text[e].isalnum() or text[e] in "\"'/_%@-")))
    groups = 9 <= n <= 15 and bool(_GROUPS_SHAPE.match(seg))
    return f, [16] * (e - s > 60) + [17] * (tokens == 1) + [18] * groups + [19] * bool(_DATE_SHAPE.search(seg)) + [21] * (groups and seg.lstrip("(")[0] == "0")


def cued(text: str, s: int) -> list[str]:
    """The kinds of which a cue stands before s."""
    before = text[max(0, s - 24) : s].lower()
    return [k for k in KINDS if any(c in before for c in _CUES[k])]


def segment_features(text: str, s: int, e: int, tokens: int, kind: str) -> list[int]:
    """Indices of the features that hold for text[s:e] as a span of `kind`."""
    f, rest = plain_features(text, s, e, tokens)
    return f + with_cue(kind in cued(text, s), rest)


def with_cue(cue: bool, rest: list[int]) -> list[int]:
    """The features after the cue, and those of a cue."""
    return [15] * cue + rest + [20] * (cue and 18 in rest)


def shaped(seg: str, digits: int) -> bool:
    """Whether a segment has one of SHAPES."""
    if digits and (
        _GROUPS_SHAPE.match(seg) and 9 <= digits <= 15 or _PHONE_SHAPE.match(seg) or _CARD_SHAPE.match(seg) or digits <= 12 and _IP_SHAPE.match(seg) or 14 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", seg))
    ):
        return True
    return _MARKS.search(seg) is not None and _ADDRESS.match(plain_address(seg)) is not None


def segments(text: str, lo: int, hi: int, taken: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens of text[lo:hi], and (first, last+1) of its candidate segments: those that hold
    seven digits or the marks of an address, have one of SHAPES, begin and end in a way that
    a span can, and touch no span that is taken."""
    toks = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    covered = np.zeros(hi - lo + 1, bool)
    for s, e in taken:
        covered[max(0, s - lo) : max(0, e - lo)] = True
    free = [not covered[s - lo : e - lo].any() for s, e in toks]
    out = []
    for i, (s, _) in enumerate(toks):
        c = text[s]
        if not (c.isalnum() or c in "(+"):
            continue
        digits = 0
        for j in range(i, min(len(toks), i + MAX_TOKENS)):
            if not free[j]:
                break
            x, y = toks[j]
            if y - s > SEGMENT or "\n" in text[s:y]:
                break
            if text[x].isdigit():
                digits += y - x
                if digits > MOST_DIGITS:
                    break
            if text[y - 1].isalnum() and (digits >= 7 or digits >= 4 and j - i >= 6 or _MARKS.search(text, s, y)) and shaped(text[s:y], digits):
                out.append((i, j + 1))
    return toks, out


class SegmentCrf:
    """Weights of each kind over FEATURE_NAMES; a token outside scores 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def scored(self, text: str, toks, cands) -> list[tuple[int, int, str, float]]:
        """(i, j, kind, score) of each candidate; what doesn't depend on the kind is found once for all."""
        cues = {i: cued(text, toks[i][0]) for i in {i for i, _ in cands}}
        weights, out = {k: w.tolist() for k, w in self.w.items()}, []
        for i, j in cands:
            f, rest = plain_features(text, toks[i][0], toks[j - 1][1], j - i)
            plain, cue = f + with_cue(False, rest), f + with_cue(True, rest)
            out += [(i, j, k, sum([weights[k][x] for x in (cue if k in cues[i] else plain)])) for k in KINDS]
        return out

    def decode(self, text: str, lo: int, hi: int, taken) -> list[Span]:
        """Best segmentation; a span is kept if its score exceeds MARGIN."""
        toks, cands = segments(text, lo, hi, taken)
        if not cands:
            return []
        ending: dict[int, list] = {}
        for i, j, k, s in self.scored(text, toks, cands):
            if s > MARGIN:
                ending.setdefault(j, []).append((i, k, s))
        best, back = [0.0] * (len(toks) + 1), [None] * (len(toks) + 1)
        for j in range(1, len(toks) + 1):
            best[j] = best[j - 1]
            for i, k, s in ending.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], len(toks)
        while j > 0:
            if back[j]:
                i, k = back[j]
                out.append((k, toks[i][0], toks[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Spans to add, none touching a base span.

        A candidate segment has SEGMENT characters at most and holds a trigger: what the text
        has within SEGMENT characters of a trigger is all that candidates can reach.  Regions
        that overlap are decoded as one."""
        out: list[Span] = []
        regions: list[list[int]] = []
        for m in (_TRIGGER if spelled(text) else _DIGIT_TRIGGER).finditer(text):
            lo, hi = max(0, m.start() - SEGMENT), min(len(text), m.end() + SEGMENT)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], hi)
            else:
                regions.append([lo, hi])
        at, taken = 0, sorted((s, e) for _, s, e in base)
        for lo, hi in regions:
            while at < len(taken) and taken[at][1] <= lo:
                at += 1
            near = []
            for s, e in taken[at:]:
                if s >= hi:
                    break
                near.append((s, e))
            out += self.decode(text, lo, hi, near)
        return out


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with marked spans, and with look-alikes that aren't personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(2, 8)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        body = num(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email():
        a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), (" @ ", "."), ("[at]", ".")])
        return f"{word()}{r.choice(['', '.' + word(), num(2)])}{a}{word()}{d}{r.choice(['com', 'org', 'net', 'de'])}"

    def phone():
        if r.random() < 0.4:  # as written in other countries; a country code or trunk zero, groups of two to five
            lead = r.choice([f"0{num(2)}", f"0{num(3)}", f"(0{num(2)})", f"0{num(1)}", f"{r.randint(20, 99)} {num(2)}", f"00{r.randint(20, 99)} {num(2)}", f"{r.randint(20, 99)} (0){num(2)}"])
            return lead + r.choice([" ", "-", "/", " / ", " "]) + r.choice([f"{num(3)} {num(4)}", f"{num(4)} {num(4)}", num(7), f"{num(3)}-{num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}"])
        return r.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "001 {} {} {}"]).format(num(3), num(3), num(4))

    def spaced_card():
        c = card()
        return r.choice(["  ", " - ", "."]).join([c[:4], c[4:8], c[8:12], c[12:]])

    def ip():
        return r.choice([" . ", " dot "]).join(str(r.randint(0, 255)) for _ in range(4))

    def no_card():
        parts = [r.choice([num(4), f"19{num(2)}", f"20{num(2)}"]) for _ in range(4)]
        return r.choice([" ", "  ", " - ", "."]).join(parts) if not luhn("".join(parts)) else parts[0]

    def clean():
        return r.choice([
            no_card, no_card,
            lambda: f"password={num(4)}{word()}{num(9)}", lambda: f'token = "{num(8)}{word()}{num(12)}"', lambda: num(r.randint(7, 9)), lambda: num(r.randint(10, 13)),
            lambda: num(r.randint(20, 30)), lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{num(2)} {num(2)}:{num(2)}", lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.19{num(2)} {num(4)}", lambda: f"{num(3)}/{num(3)}", lambda: f"{r.randint(10, 99)}/{num(6)}/{num(2)}",
            lambda: f"{num(2)} {num(3)} {num(3)}", lambda: f"{r.randint(1, 9)} {num(3)} {num(3)} {num(3)}", lambda: f"19{num(2)}-20{num(2)} {num(4)}", lambda: f"{num(4)}-{num(4)}-{num(4)}", lambda: f"§ {num(2)}/{num(2)} {num(4)}", lambda: f"20{num(2)}-0{num(1)}-1{num(1)} 1{num(1)}:{num(2)}:{num(2)}", lambda: f"ISBN 978-{num(1)}-{num(5)}-{num(3)}-{num(1)}",
            lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"${num(3)},{num(3)},{num(3)}", lambda: f"order #{num(9)}", lambda: f"{word()} at {word()} {word()}.", lambda: f"met at {word()}. {word()} dot",
            lambda: " ".join(num(r.randint(1, 5)) for _ in range(r.randint(4, 9))), lambda: f"{num(4)} {num(4)}", lambda: f"AKIA{num(3)}X{num(4)}Z{num(5)}", lambda: f"{num(3)} . {num(3)} . {num(2)}", lambda: f"id-{num(3)}-{num(3)}-{num(4)}-{num(6)}",
        ])()

    makers = {"email": email, "phone": phone, "card": spaced_card, "ip": ip}
    cues = {"email": ["mail", "contact"], "phone": ["call", "tel", "phone", "mobile", "fax:", "tel."], "card": ["card", "visa"], "ip": ["host", "ip", "server"]}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 3))) + " ", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                text += f"{r.choice(cues[kind])} " * (r.random() < 0.5)
                s = len(text)
                text += makers[kind]()
                spans.append((kind, s, len(text)))
            else:
                text += clean()
            text += r.choice([" ", ", ", ". "]) + " ".join(word() for _ in range(r.randint(1, 3))) + " "
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=2)
def train(n: int = 600, seed: int = 11, steps: int = 30) -> SegmentCrf:
    """Conditional likelihood of made-up examples, by gradient steps with forward-backward sums.

    Labels for such spans aren't among the tables, so the examples are generated: n
    sentences, the same for any input."""
    data = []
    for text, spans in examples(n, seed):
        toks, cands = segments(text, 0, len(text), [])
        rows = [(i, j, k) for i, j in cands for k in range(len(KINDS))]
        if not rows:
            continue
        x = np.zeros((len(rows), len(FEATURE_NAMES)))
        truth = {(s, e, KINDS.index(k)) for k, s, e in spans}
        gold = np.zeros(len(rows))
        for r, (i, j, k) in enumerate(rows):
            x[r, segment_features(text, toks[i][0], toks[j - 1][1], j - i, KINDS[k])] = 1
            gold[r] = (toks[i][0], toks[j - 1][1], k) in truth
        data.append((len(toks), rows, x, gold))
    w = np.zeros((len(KINDS), len(FEATURE_NAMES)))
    kinds = [np.array([k for _, _, k in rows]) for _, rows, _, _ in data]
    square = np.full_like(w, 1e-6)
    for _ in range(steps):
        grad = -0.01 * w
        for (n_tok, rows, x, gold), kind in zip(data, kinds, strict=True):
            score = np.clip((x * w[kind]).sum(axis=1), -30, 30)
            weight = np.exp(score)
            ahead, behind = [0.0] * (n_tok + 1), [0.0] * (n_tok + 1)
            ahead[0] = behind[n_tok] = 1.0
            by_end: dict[int, list] = {}
            by_start: dict[int, list] = {}
            for r, (i, j, _) in enumerate(rows):
                by_end.setdefault(j, []).append((i, weight[r]))
                by_start.setdefault(i, []).append((j, weight[r]))
            for j in range(1, n_tok + 1):
                ahead[j] = ahead[j - 1] + sum(ahead[i] * v for i, v in by_end.get(j, ()))
            for i in range(n_tok - 1, -1, -1):
                behind[i] = behind[i + 1] + sum(behind[j] * v for j, v in by_start.get(i, ()))
            expected = np.array([ahead[i] * weight[r] * behind[j] for r, (i, j, _) in enumerate(rows)]) / ahead[n_tok]
            np.add.at(grad, kind, (gold - expected)[:, None] * x)
        square += grad**2
        w += 0.7 * grad / np.sqrt(square)
    assert math.isfinite(float(w.sum()))
    return SegmentCrf({k: w[i] for i, k in enumerate(KINDS)})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def spelled(text: str) -> bool:
    """Whether a text may hold what _TRIGGER finds besides digit runs: brackets, @, dot or at are in any such text; plain searches first."""
    return ("@" in text or "dot" in text.lower() or _BRACKETS.search(text) is not None or _AT_WORD.search(text) is not None) and _MARKS.search(text) is not None


def find_spans(text: str, crf: SegmentCrf) -> tuple[list[Span], list[Span]]:
    """Base spans and added ones."""
    base = base_spans(text)
    return base, crf.spans(text, base) if _DIGIT.search(text) or spelled(text) else []


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the union, by the first one's kind."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: SegmentCrf | None = None) -> DataFrame:
    """id, counts of the base spans by kind, base_sha256, spans (base and added), n_added.

    A null text is an empty one; it has no spans.  Rows are independent, so repeated rows
    and null ids come back as they are.
    """
    crf = crf or train()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            got = []
            for t in batch.column(1).to_pylist():
                base, added = find_spans(t, crf) if t else ([], [])
                got.append((*(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            cols = list(zip(*got, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(cols))], names=names)

    return docs.select(*numbered([id_col, text_col])).mapInArrow(tidy(run), fields(docs.schema, [id_col])[0] + ", " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


#: Bytes of text that are Python strings at a time.
SLICE = 4_000_000


def redact(docs: DataFrame, text_col: str = "text", crf: SegmentCrf | None = None) -> DataFrame:
    """The rows with spans in text_col replaced; a null text stays null."""
    crf = crf or train()
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, at, SLICE)):
            new = []
            for t in batch.column(at).to_pylist():
                base, added = find_spans(t, crf) if t else ([], [])
                new.append(redacted(t, base + added) if base or added else t)
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(new, pa.string())).rename_columns(schema.names)

    return docs.select(*numbered(docs.columns)).mapInArrow(tidy(run), schema)
