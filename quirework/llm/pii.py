"""Personal data: exact base patterns and a semi-Markov conditional random field.

Base: the contract's four kinds, leftmost and non-overlapping, found without
quadratic retries.  Method: the neighbourhood of every place with a trigger (a
digit, an ``@``, a spelled-out "at") is cut into whole tokens; a semi-Markov CRF scores
whole candidate segments of at most ``MAX_TOKENS`` tokens by features of the
span (digits, dots, checks, cue words before it), and dynamic programming picks
boundaries and kinds jointly.  Base spans always stay; CRF spans are added where
they overlap no base span.

The weights are trained here (conditional likelihood, exact forward sums) on
sentences generated from a fixed seed, with hard negatives such as versions,
prices, dates and hexadecimal keys.  Null and empty texts have no spans;
repeated documents are scanned each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quirework.llm.common import batch_of, map_arrow, table, text_of

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 9
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9]){12}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    dotted = "." in text
    if dotted:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
    if _DIGIT_RUN.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the semi-Markov CRF -------------------------------------------------

_TOKEN = re.compile(r"\S+")
#: Letters and marks of other scripts than Latin.
_OTHER = r"\u0370-\u1DFF\u1F00-\u1FFF\u2C00-\uD7FF\uF900-\uFFEF\U00010000-\U0003FFFF"
#: Where a token is cut: a number after a name and its mark, or after a list's
#: mark, and a change between a number and another script.
_CUT = re.compile(
    rf"(?<=[^\W\d_][:=;,|])(?=[+(0-9])|(?<=[0-9][;,|])(?=[^\W\d_(+])|(?<=[{_OTHER}])(?=[+(0-9])|(?<=[0-9)])(?=[{_OTHER}])"
)
#: A token of more characters is cut at all marks that no kind holds, and what is
#: still longer also where numbers begin and end.
LONG = 120
_PARTS = re.compile(r"[\w.%+@()\[\]-]+|[^\w.%+@()\[\]-]+")
_NUMBERS = re.compile(r"\(?\+?[0-9]+\)?[.-]?|[^0-9(+]+|[(+]+")
#: Seven digits near each other, four dotted numbers, an at sign or a spelled-out one.
_TRIGGER = re.compile(
    r"@|\[at\]|\(at\)|\bat \S{1,40} dot\b|[0-9](?:[ ().-]{0,3}[0-9]){6}|(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
)
_CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel".split()),
    "ip": frozenset("ip host address server".split()),
    "card": frozenset("card visa credit mastercard karte carte tarjeta".split()),
    "phone": frozenset("tel phone call telephone mobile fax telefon téléphone teléfono".split()),
}
_SPELLED = re.compile(r"[\w.%+-]+ ?(?:\[at\]|\(at\)| at ) ?[\w-]+(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[\w-]+)+")
_PHONE_SHAPE = re.compile(r"\(?\+?[0-9][0-9() .-]*[0-9]")
_NAMES = (
    "bias at_sign spelled ip_shape ip_range card_len luhn grouped phone_len phone_shape parens plus "
    "cue few_digits letters_digits decimal tokens edge_punct"
).split()
_WIDTH = len(_NAMES)


def features(kind: str, span: str, before: tuple[str, ...], n: int) -> np.ndarray:
    """What a whole segment shows for a kind."""
    f = np.zeros(_WIDTH)
    core = span.strip(".,;:!?\"'<>")
    digits = "".join(c for c in core if c in "0123456789")
    n_letters = sum(c.isalpha() for c in core)
    f[0] = 1
    f[1] = "@" in core and "." in core.rpartition("@")[2]
    f[2] = bool(_SPELLED.fullmatch(core))
    parts = core.split(".")
    numeric = len(parts) == 4 and all(x.isdigit() for x in parts)
    f[3] = numeric
    f[4] = numeric and all(len(x) < 4 and int(x) < 256 for x in parts)
    f[5] = 13 <= len(digits) <= 19 and not n_letters
    f[6] = bool(f[5]) and luhn(digits)
    f[7] = all(len(x) == 4 for x in re.split("[ -]", core)) and len(digits) == 16
    f[8] = 9 <= len(digits) <= 15 and not n_letters
    f[9] = bool(_PHONE_SHAPE.fullmatch(core)) and any(c in core for c in " ()-+")
    f[10] = "(" in core and ")" in core
    f[11] = core.startswith("+")
    f[12] = any(w in _CUES[kind] for w in before)
    f[13] = len(digits) < 7
    f[14] = n_letters > 0 and len(digits) > 0
    f[15] = bool(re.fullmatch(r"[0-9]+[.,][0-9]+", core))
    f[16] = n / MAX_TOKENS
    f[17] = core != span and n > 1 and span[0] in "\"'<"
    return f


def candidate(kind: str, span: str) -> bool:
    """A cheap gate: segments that can't be of the kind aren't scored."""
    digits = sum(c in "0123456789" for c in span)
    if kind == "email":
        return "@" in span or bool(_SPELLED.search(span))
    if kind == "ip":
        return digits >= 4 and span.count(".") >= 3
    letters = sum(c.isalpha() for c in span)
    if kind == "card":
        return letters == 0 and 12 <= digits <= 19
    return letters == 0 and 7 <= digits <= 15


class SemiCRF:
    """Weights per kind over whole-span features; outside tokens score zero."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.w = weights or {k: np.zeros(_WIDTH) for k in KINDS}

    @staticmethod
    def segments(tokens: list[tuple[int, int]], text: str):
        """(first, end, kind, features) of the candidate segments."""
        return list(SemiCRF.walk(tokens, text))

    @staticmethod
    def walk(tokens: list[tuple[int, int]], text: str):
        """The candidate segments one by one, by their first token.  A token that
        is still longer than ``LONG`` is no part of one."""
        words = [text[s : min(e, s + LONG)].lower().strip(".,;:!?()\"'<>=|") for s, e in tokens]
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                if tokens[j - 1][1] - tokens[j - 1][0] > LONG:
                    break
                span = text[tokens[i][0] : tokens[j - 1][1]]
                for kind in KINDS:
                    if candidate(kind, span):
                        yield i, j, kind, features(kind, span, tuple(words[max(0, i - 2) : i]), j - i)

    def gradient(self, n: int, segments, gold: set[tuple[int, int, str]]):
        """Log-likelihood and gradient of one window by forward-backward sums."""
        scores = np.array([f @ self.w[k] for _, _, k, f in segments])
        ends: dict[int, list[int]] = {}
        for x, (_, j, _, _) in enumerate(segments):
            ends.setdefault(j, []).append(x)
        ahead = np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[segments[x][0]] + scores[x] for x in ends.get(j, ()))])
        begins: dict[int, list[int]] = {}
        for x, (i, _, _, _) in enumerate(segments):
            begins.setdefault(i, []).append(x)
        behind = np.zeros(n + 1)
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[segments[x][1]] + scores[x] for x in begins.get(i, ()))])
        grad = {k: np.zeros(_WIDTH) for k in KINDS}
        right = -ahead[n]
        for x, (i, j, k, f) in enumerate(segments):
            p = np.exp(ahead[i] + scores[x] + behind[j] - ahead[n])
            hit = (i, j, k) in gold
            right += scores[x] * hit
            grad[k] += (hit - p) * f
        return right, grad

    def decode(self, n: int, segments) -> list[tuple[int, int, str]]:
        """The best segmentation; ``segments`` come by their first token, so
        none has to be kept."""
        best, back = np.full(n + 1, -np.inf), [None] * (n + 1)
        best[0], done = 0, 0

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if best[done - 1] >= best[done]:
                    best[done], back[done] = best[done - 1], None

        for i, j, k, f in segments:
            settle(i)
            score = best[i] + float(f @ self.w[k])
            if score > best[j]:
                best[j], back[j] = score, (i, k)
        settle(n)
        out, j = [], n
        while j:
            if back[j]:
                i, k = back[j]
                out.append((i, j, k))
                j = i
            else:
                j -= 1
        return out[::-1]


def _example(rng: random.Random) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Words of a generated sentence and its gold segments."""
    word = lambda: "".join(rng.choice("aeiourstnlmdk") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    failing = lambda d: d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)
    words, gold = [word() for _ in range(rng.randint(1, 5))], []
    for _ in range(rng.randint(1, 2)):
        kind = rng.choice([*KINDS, "none", "none"])
        cue = rng.random() < 0.4
        if kind == "email":
            user, host = word() + rng.choice(["", ".", "_"]) + word(), word() + rng.choice([".com", ".org", ".de"])
            made = rng.choice([f"{user}@{host}", f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host}"])
        elif kind == "ip":
            made = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == "card":
            n = rng.choice([13, 15, 16, 16, 16, 19])
            body = num(n - 1)
            digits = next(body + c for c in "0123456789" if luhn(body + c))
            made = rng.choice([digits, " ".join(digits[i : i + 4] for i in range(0, n, 4)), "-".join(digits[i : i + 4] for i in range(0, n, 4))])
        elif kind == "phone":
            made = rng.choice([f"+{num(2)} {num(3)} {num(7)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"])
            cue = cue or not made.startswith(("+", "("))
        else:
            cue = False
            made = rng.choice([num(rng.randint(1, 6)), f"{num(2)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", f"key={num(4)}{word()}{num(6)}", f"${num(3)},{num(3)}", f"{word()} at {word()}", num(10), num(8), f"{num(4)} {num(4)}", failing(num(16)), failing(num(rng.randint(13, 19))), failing(num(16)), f"{num(3)} {num(4)} {num(2)}", f"{num(3)}.{num(3)}.{num(1)}.{num(4)}"])
        if cue and kind in _CUES:
            words.append(rng.choice(sorted(_CUES[kind])) + rng.choice(["", ":"]))
        i = len(words)
        words += made.split(" ")
        if kind != "none":
            gold.append((i, len(words), kind))
        words[-1] += rng.choice(["", "", ".", ","])
        words += [word() for _ in range(rng.randint(1, 4))]
    return words, gold


@functools.cache
def trained(examples: int = 500, epochs: int = 12, seed: int = 7) -> SemiCRF:
    """A CRF fitted on generated sentences; the same for the same arguments."""
    rng, crf = random.Random(seed), SemiCRF()
    data = []
    for _ in range(examples):
        words, gold = _example(rng)
        text, tokens, at = " ".join(words), [], 0
        for w in words:
            tokens.append((at, at + len(w)))
            at += len(w) + 1
        if segments := SemiCRF.segments(tokens, text):
            data.append((len(tokens), segments, set(gold)))
    for epoch in range(epochs):
        rng.shuffle(data)
        for n, segments, gold in data:
            _, grad = crf.gradient(n, segments, gold)
            for k in KINDS:
                crf.w[k] += 0.3 / (1 + epoch) * (grad[k] - 0.002 * crf.w[k])
    return crf


def tokens_of(text: str, start: int, end: int):
    """The tokens of the whitespace token at [start, end)."""
    if end - start <= LONG:
        at = start
        for m in _CUT.finditer(text, start, end):
            if m.start() > at:
                yield at, m.start()
                at = m.start()
        yield at, end
        return
    for m in _PARTS.finditer(text, start, end):
        if m.end() - m.start() <= LONG:
            yield from tokens_of(text, *m.span())
        else:
            yield from (x.span() for x in _NUMBERS.finditer(text, *m.span()))


def windows(text: str, reach: int = MAX_TOKENS + 2):
    """Tokens around triggers: ``reach`` whole ones on both sides, which holds
    every segment with a part of the trigger and the words before it.  Windows
    that meet are one, whatever its length."""
    hits = [m.span() for m in _TRIGGER.finditer(text)]
    if not hits:
        return
    spans = [m.span() for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in spans]
    ranges: list[list[int]] = []
    for s, e in hits:
        lo = max(0, bisect.bisect_right(starts, s) - 1 - reach)
        hi = min(len(spans), bisect.bisect_left(starts, e) + reach)
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = max(hi, ranges[-1][1])
        else:
            ranges.append([lo, hi])
    for lo, hi in ranges:
        yield [t for s, e in spans[lo:hi] for t in tokens_of(text, s, e)]


def crf_spans(text: str, crf: SemiCRF, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """CRF spans that overlap no base span, left to right."""
    out: list[tuple[str, int, int]] = []
    taken = sorted((s, e) for _, s, e in base)
    firsts = [s for s, _ in taken]
    ends = list(itertools.accumulate((e for _, e in taken), max))
    for tokens in windows(text):
        for i, j, kind in crf.decode(len(tokens), SemiCRF.walk(tokens, text)):
            s, e = tokens[i][0], tokens[j - 1][1]
            while e > s and text[e - 1] in ".,;:!?\"'<>|":
                e -= 1
            while s < e and text[s] in "\"'<":
                s += 1
            before = bisect.bisect_left(firsts, e)  # base spans that begin before the end
            if s < e and not (before and ends[before - 1] > s):
                out.append((kind, s, e))
    return out


def in_order(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def scan(weights: dict[str, np.ndarray]):
    def work(batches):
        crf = SemiCRF(weights)
        for batch in batches:
            counts, sha, spans, clean = {k: [] for k in KINDS}, [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                every = base + crf_spans(text, crf, base)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(in_order(base).encode()).hexdigest())
                spans.append(in_order(every))
                clean.append(redacted(text, every) if every else None)
            yield batch_of(
                doc_id=batch.column("doc_id"),
                **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in KINDS},
                base_sha256=pa.array(sha, pa.string()),
                spans=pa.array(spans, pa.string()),
                redacted=pa.array(clean, pa.string()),
                **{n: batch.column(n) for n in batch.schema.names if n not in ("doc_id", "text")},
            )

    return work


def redacted(text: str, spans) -> str:
    """The text with every span replaced by its kind; overlaps go together."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """Counts, spans and the redacted text (null where nothing was found);
    ``keep`` names columns to carry on."""
    extra = [c for c in keep if c not in ("doc_id", "text")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_arrow(
        docs.select("doc_id", text_of().alias("text"), *extra),
        scan(trained().w),
        f"doc_id {kinds['doc_id']}, "
        + "".join(f"n_{k} long, " for k in KINDS)
        + "base_sha256 string, spans string, redacted string"
        + "".join(f", {c} {kinds[c]}" for c in extra),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("redacted")
