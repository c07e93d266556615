"""Tokenizers, margin keys and scalar text functions, all JVM-side.

Letters and digits are ``[\\p{L}\\p{N}]`` unless a function says otherwise.  A
null text gives a null result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _split(text: Column, by: str) -> Column:
    return F.array_remove(F.split(text, by), "")


def tok_alnum(text) -> Column:
    """Lower-case runs of letters and digits."""
    return _split(F.lower(col(text)), NOT_ALNUM)


def tok_alnum2(text) -> Column:
    """The same, two characters at least."""
    return F.filter(tok_alnum(text), lambda w: F.length(w) >= 2)


def tok_alnum_hyphen(text) -> Column:
    """Lower-case runs of letters, digits and hyphens."""
    return _split(F.lower(col(text)), r"[^\p{L}\p{N}-]+")


def tok_spaces(text) -> Column:
    """White-space tokens that hold a letter or digit."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def tok_vocabulary(text) -> Column:
    """Tokens made of letters alone."""
    return F.filter(tok_alnum(text), lambda w: w.rlike(r"^\p{L}+$"))


def squeeze(text) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(text), r"\s+", " "), r"^ | $", "")


def trim_space(text) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def key_cleanup(text) -> Column:
    """Margin key: digits alike, no punctuation, digit runs one."""
    t = F.regexp_replace(F.lower(col(text)), "[0-9]", "#")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}#\s]", "")
    return F.regexp_replace(squeeze(t), "##+", "#")


def key_heading(text) -> Column:
    """Margin key that keeps punctuation and the number of digits."""
    return squeeze(F.regexp_replace(F.lower(col(text)), "[0-9]", "#"))


def key_evaluation(text) -> Column:
    """Margin key that keeps punctuation, digit runs one."""
    return F.regexp_replace(key_heading(text), "##+", "#")


def numbers_in(words) -> Column:
    """Words that hold an ASCII digit."""
    return F.filter(col(words), lambda w: w.rlike("[0-9]"))


def letters_only(text) -> Column:
    return F.lower(F.regexp_replace(col(text), r"[^\p{L}\p{N}]", ""))


def block_key(text) -> Column:
    """The first 16 hex digits of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(trim_space(text), 256), 1, 16)


def excerpt(text, most: int = 180) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def digit_groups(text) -> Column:
    return F.sort_array(F.regexp_extract_all(col(text), F.lit("([0-9]+)"), 1))


def decimal_numbers(text) -> Column:
    """Numbers with the decimal comma as a point."""
    return F.transform(
        F.regexp_extract_all(col(text), F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), 1), lambda x: F.translate(x, ",", ".")
    )


def link_targets(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"\]\(([^)]*)\)"), 1)


def occurrences(text, mark: str) -> Column:
    """Non-overlapping places of a string."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def inline_marks(text) -> Column:
    """Counts of inline markup; two blocks agree when these do."""
    return F.struct(
        occurrences(text, "**").alias("strong"),
        occurrences(text, "__").alias("under"),
        occurrences(text, "`").alias("code"),
        occurrences(text, "](").alias("links"),
        occurrences(text, "[").alias("open"),
        occurrences(text, "]").alias("close"),
        (occurrences(F.replace(col(text), F.lit("**"), F.lit("")), "*") % 2).alias("odd"),
    )


def strip_inline(text) -> Column:
    """Without inline markup; links keep their text."""
    t = F.regexp_replace(col(text), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(t, r"\*\*|__|`|\*", "")


def contains_word(text, word: Column) -> Column:
    """Whole-word containment, letters and digits being word characters."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(col(text)), NOT_ALNUM, "  "), F.lit(" "))
    needle = F.concat(F.lit(" "), F.regexp_replace(F.lower(word), NOT_ALNUM, "  "), F.lit(" "))
    return F.contains(padded, needle)


def contains_words(outer: Column, inner: Column) -> Column:
    """Whether word array ``inner`` stands consecutively in ``outer``."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(pad(outer), pad(inner))


def xml_safe(text) -> Column:
    """Without characters that XML 1.0 forbids."""
    return F.regexp_replace(col(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def xml_escape(text) -> Column:
    t = F.replace(col(text), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


#: Media types by extension.
MEDIA = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "webp": "image/webp",
}


def media_type(path) -> Column:
    kind = F.lower(F.element_at(F.split(col(path), r"\."), -1))
    out = F.lit(None).cast("string")
    for k, v in MEDIA.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


#: The document formats that are read.
FORMATS = ("pdf", "docx", "epub", "html", "htm", "txt", "md", "markdown")


def supported(path) -> Column:
    return F.lower(F.element_at(F.split(col(path), r"\."), -1)).isin(*FORMATS) & F.contains(col(path), F.lit("."))


#: The letters of each script by code-point range.
SCRIPTS = {
    "latin": r"\x{0}-\x{24F}\x{1E00}-\x{1EFF}",
    "greek": r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}",
    "cyrillic": r"\x{400}-\x{52F}",
    "hebrew": r"\x{590}-\x{5FF}",
    "arabic": r"\x{600}-\x{6FF}",
    "cjk": r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}",
}


def script_letters(text, script: str) -> Column:
    """How many letters of a script the text holds; "other" are those of none."""
    t = col(text)
    if script == "other":
        return F.length(F.regexp_replace(t, rf"[\P{{L}}{''.join(SCRIPTS.values())}]", ""))
    return F.length(t) - F.length(F.regexp_replace(t, rf"[{SCRIPTS[script]}&&\p{{L}}]", ""))


def main_script(text) -> Column:
    """The script with most letters; ties go to the first by name."""
    pairs = F.array(*(F.struct((-script_letters(text, s)).alias("n"), F.lit(s).alias("s")) for s in sorted(SCRIPTS)))
    best = F.array_min(pairs)
    return F.when(best["n"] < 0, best["s"])


#: What may follow a number in an ordinal.
ORDINALS = ("st", "nd", "rd", "th", "d", "o", "a", "er", "e", "re", "eme", "ème", "º", "ª", "os", "as", "do", "to")


def odd_form(token) -> Column:
    """A token as it is judged: without marks at its ends."""
    return F.regexp_replace(col(token), "^[^\\p{L}\\p{N}\uFFFD]+|[^\\p{L}\\p{N}\uFFFD]+$", "")


def may_be_odd(text, main=None) -> Column:
    """Whether a text holds a digit, a replacement character or letters of another
    script, as every odd token does."""
    foreign = F.lit(False)
    if main is not None:
        foreign = (col(main) != "latin") | col(text).rlike("[" + "".join(r for s, r in SCRIPTS.items() if s != "latin") + "]")
    return col(text).rlike("[\\p{N}\uFFFD]") | F.coalesce(foreign, F.lit(False))


def is_odd(token, main=None) -> Column:
    """A replacement character, a letter of another script than the ``main`` one,
    or letters and digits mixed, but for ordinals ("3rd") and codes of one letter
    ("A25"); link parts are not looked at."""
    # most tokens hold no digit and no other letters: they are told by one look
    maybe = may_be_odd(token, main)
    t = odd_form(token)
    kinds = F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    switches = F.size(F.regexp_extract_all(kinds, F.lit(r"(\p{L}(?=\p{N})|\p{N}(?=\p{L}))"), 1))
    ordinal = t.rlike(r"^[\p{N}&&[^0]]") & (switches == 1) & F.lower(F.regexp_replace(t, r"^\p{N}+", "")).isin(*ORDINALS)
    code = (switches == 1) & kinds.rlike(r"^\p{L}\p{N}")
    odd = F.contains(t, F.lit("\uFFFD")) | ((switches >= 1) & ~ordinal & ~code)
    if main is not None:
        others = F.lit(False)
        for s in SCRIPTS:
            others = others | ((col(main) != s) & t.rlike(rf"[{SCRIPTS[s]}&&\p{{L}}]"))
        odd = odd | F.coalesce(others, F.lit(False))
    return maybe & (t != "") & ~F.contains(t, F.lit("](")) & odd


def utc_text(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: The target languages.
LANGUAGES = {"es": "Spanish", "en": "English", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese"}


def language_name(code) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(col(code) == k, v).otherwise(out)
    return out


#: Symbols that any text may hold (fixed values).
USUAL = "«»“”‘’—–…·•°%€£§¶©®™¿¡"


def foreign_symbols(text, reference) -> Column:
    """Symbols of a text that the reference has nowhere, each once, in order."""
    return F.filter(unusual(text), lambda c: ~F.contains(col(reference), c))


def unusual(text) -> Column:
    """The symbols of a text that not any text may hold, each once, in order."""
    rest = F.regexp_replace(col(text), rf"[\p{{L}}\p{{N}}\s!-/:-@\[-`{{-~{USUAL}]", "")
    return F.filter(F.array_distinct(F.split(rest, "")), lambda c: c != "")


def clean_output(text) -> Column:
    """A model's output without terminal codes and its end mark."""
    t = F.regexp_replace(col(text), "\u001b(\\[[^A-Za-z]*[A-Za-z]?)?", "")
    return trim_space(F.replace(t, F.lit("[end of text]"), F.lit("")))


#: Side that a figure has at least, of 1000.
FIGURE_SIDE = 40


def figure_box(tag) -> Column:
    """left, top, right, bottom out of ``bbox_l_t_r_b`` in an image tag, 1000 at
    most; null if there are no four numbers or the figure is too small."""
    rx = r"bbox_([0-9]+)[_.\"']([0-9]+)[_.\"']([0-9]+)[_.\"']([0-9]+)(?:[_.\"']|$)"
    part = lambda i: F.least(F.lit(1000), F.regexp_extract(col(tag), rx, i).try_cast("int"))
    sides = [part(i) for i in range(1, 5)]
    fits = (sides[2] >= sides[0] + FIGURE_SIDE) & (sides[3] >= sides[1] + FIGURE_SIDE)
    return F.when(fits, F.struct(*(s.alias(n) for s, n in zip(sides, ("left", "top", "right", "bottom"), strict=True))))


def format_of(name) -> Column:
    """The format label of a file name."""
    ext = F.lower(F.element_at(F.split(col(name), r"\."), -1))
    return F.when(ext == "markdown", "md").when(ext == "htm", "html").otherwise(ext)


def stem(name) -> Column:
    return F.regexp_replace(col(name), r"(?i)\.[a-z0-9]+$", "")


def tenths(x: Column) -> Column:
    """Ten times a double >= 0 as a whole number, rounded as printf does: by the
    double's exact value, not its shortest decimal (1.65 is below 1.65), ties to
    even."""
    eight, two = x * 8, x * 2  # both exact; ``lost`` is what their sum rounds off
    high = eight + two
    lost = two - (high - eight)
    whole = F.floor(high)
    rest = high - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    return whole + up.cast("long")


def duration_label(seconds) -> Column:
    """Seconds under 90, minutes under 90, else hours with a decimal comma."""
    s = col(seconds).cast("double")
    hours = tenths(s / 3600)
    return (
        F.when(s < 90, F.concat(F.greatest(F.lit(1), F.floor(s + 0.5)).cast("string"), F.lit(" s")))
        .when(s < 5400, F.concat(F.floor(s / 60 + 0.5).cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(hours / 10).cast("string"), F.lit(","), (hours % 10).cast("string"), F.lit(" h")))
    )


def plural(n, one: str, many: str) -> Column:
    """A number with its noun; points part thousands from five digits on."""
    digits = F.when(F.abs(col(n)) >= 10000, F.replace(F.format_number(col(n), 0), F.lit(","), F.lit("."))).otherwise(col(n).cast("string"))
    return F.concat(digits, F.when(col(n) == 1, f" {one}").otherwise(f" {many}"))


def data_uri(path, content) -> Column:
    """A file as a data URI."""
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def translation_limits(text, least: int, most: int) -> Column:
    """Token limit, context (whole 1024s between the bounds) and seconds that a
    translation of a text gets."""
    words = F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))
    tokens = F.greatest(F.lit(64), F.least(F.lit(6144), words * 4))
    needed = F.ceil((F.floor(F.octet_length(col(text)) / 3) + 400 + tokens) / 1024).cast("int") * 1024
    return F.struct(
        tokens.alias("tokens"),
        F.greatest(F.lit(least), F.least(F.lit(most), needed)).alias("context"),
        F.greatest(F.lit(120), words * 2).alias("seconds"),
    )


def reread_tokens(words) -> Column:
    """The token limit of a second reading of a page of so many words."""
    return F.greatest(F.lit(1024), F.least(F.lit(4096), col(words) * 6))
