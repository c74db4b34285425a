"""Normalisation, redaction and tokens of ticket text, as column expressions.

Patterns are taken in their Unicode sense ((?U)), as the rules were written for a Unicode regular expression engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions import rules as R


def _sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(by))


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in literal)


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return _strip(_sub(text, r"\s+", " "))


def _strip(text: Column) -> Column:
    return _sub(text, r"^\s+|\s+$", "")


def _pairs_squeezed(text: Column) -> Column:
    return _strip(_sub(text, r"\s{2,}", " "))


def strip_control(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, without zero-width characters, control characters as spaces; with ascii_only other characters go too.

    Java has no SQL function for NFKC, so text that is not ASCII passes through a vectorised function; ASCII is its own NFKC.
    """
    out = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(_nfkc()(text))
    out = _sub(out, "[\u200b-\u200d\ufeff]", "")
    out = F.regexp_replace(out, r"[\x00-\x1F\x7F-\x9F]", " ")
    return _pairs_squeezed(F.regexp_replace(out, r"[^\x00-\x7F]", "") if ascii_only else out)


def _nfkc():
    import unicodedata

    import pandas as pd

    def nfkc(s):
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    nfkc.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(nfkc, "string")


def strip_html(text: Column) -> Column:
    return _sub(text, R.HTML_TAG, " ")


def placeholders(text: Column) -> Column:
    """Tags, URLs, e-mail and IP addresses and numbers of eight digits or more as typed placeholders; null is empty."""
    known = "|".join(R.TAG_NAMES)
    out = F.coalesce(text, F.lit(""))
    # Known tags first, in upper case; what still is a tag is OTHER.
    for name in R.TAG_NAMES:
        out = _sub(out, rf"(?i)<\s*{name}\s*>", f" _PH_{name}_ ")
    out = _sub(out, R.TAG, " _PH_OTHER_ ") if known else out
    for kind, pattern in R.PLACEHOLDERS:
        out = _sub(out, pattern, f" _PH_{kind}_ ")
    return _pairs_squeezed(out)


def placeholder_counts(rows: DataFrame, text: str) -> DataFrame:
    """(kind, n): tags by their upper-cased name, and URLs, addresses and long numbers, over the raw texts."""
    tags = F.transform(F.regexp_extract_all(F.col(text), F.lit("(?U)" + R.TAG), 1), lambda t: F.upper(t))
    other = [F.array_repeat(F.lit(kind), F.regexp_count(F.col(text), F.lit("(?U)" + p))) for kind, p in R.PLACEHOLDERS]
    return rows.where(F.col(text).isNotNull()).select(F.explode(F.concat(tags, *other)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def word_forms(text: Column) -> Column:
    return _pairs_squeezed(reduce(lambda t, r: _sub(t, rf"(?i)\b{_quoted(r[0])}\b", r[1]), R.WORD_FORMS, text))


def standard_terms(text: Column) -> Column:
    return _pairs_squeezed(reduce(lambda t, r: _sub(t, "(?i)" + r[0], r[1]), R.TERM_PATTERNS, text))


def drop_short_tokens(text: Column, keep: tuple[str, ...] = (), digits_too: bool = False) -> Column:
    """Without tokens of one character, but for those to keep and, unless digits_too, digits."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), 0)
    digit = lambda t: F.lit(False) if digits_too else t.rlike(r"(?U)^\d$")
    return F.array_join(F.filter(tokens, lambda t: (F.length(t) > 1) | t.isin(*keep, "") | digit(t)), " ")


def normalize(text: Column, redact: bool = True, lower: bool = True, forms: bool = True, terms: bool = True, punctuation: bool = True, digits: bool = False, short: bool = False, control: bool = False) -> Column:
    """The whole normaliser: HTML, placeholders, lower case, word forms, terms, then punctuation, digits, short tokens, spaces.

    HTML goes first, so a tag in angle brackets is gone before placeholders are taken. control also applies `strip_control`, before all.
    """
    t = F.coalesce(text, F.lit(""))
    t = strip_html(strip_control(t) if control else t)
    t = placeholders(t) if redact else t
    t = F.lower(t) if lower else t
    t = word_forms(t) if forms else t
    t = standard_terms(t) if terms else t
    return _tail(t, punctuation, digits, short)


def normalize_first_form(text: Column, redact: bool = False, lower: bool = True, forms: bool = True, terms: bool = True, punctuation: bool = True, digits: bool = False, short: bool = False) -> Column:
    """The older normaliser: control characters, placeholders before HTML, and punctuation before word forms and terms."""
    t = strip_control(F.coalesce(text, F.lit("")))
    t = strip_html(placeholders(t) if redact else t)
    t = F.lower(t) if lower else t
    t = _sub(t, r"[^\w\s]", " ") if punctuation else t
    t = _sub(t, r"\d+", " ") if digits else t
    t = word_forms(t) if forms else t
    t = standard_terms(t) if terms else t
    return _tail(t, False, False, short)


def _tail(t: Column, punctuation: bool, digits: bool, short: bool) -> Column:
    t = _sub(t, r"[^\w\s]", " ") if punctuation else t
    t = _sub(t, r"\d+", " ") if digits else t
    t = drop_short_tokens(t, ("e",)) if short else t
    return squeeze(t)


def redact(rows: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """`rows` with `out` and `counts` (map of token to number): the rules in order, each on what the one before left."""
    rows = rows.withColumn(out, F.col(text))
    seen: dict[str, list[str]] = {}
    for i, (_, token, pattern) in enumerate(R.REDACTIONS):
        name = f"_n{i}"
        seen.setdefault(token, []).append(name)
        rows = rows.withColumn(name, F.coalesce(F.regexp_count(F.col(out), F.lit("(?U)" + pattern)), F.lit(0))).withColumn(out, _sub(F.col(out), pattern, token))
    pairs = F.array(*[F.struct(F.lit(t).alias("key"), reduce(lambda a, b: a + b, map(F.col, ns)).alias("value")) for t, ns in seen.items()])
    counts = F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))
    return rows.withColumn("counts", counts).drop(*[n for ns in seen.values() for n in ns])


def token_counts(text: Column) -> Column:
    """array<string> of the tags <A_B> in a text."""
    return F.regexp_extract_all(text, F.lit(r"<[A-Z_]+>"), 0)


def _named(name: str):
    return lambda m: F.struct(F.lit(name).alias("name"), m.alias("match"))


def redact_wide(rows: DataFrame, text: str, out: str = "redacted", placeholder: bool = True, enabled: set[str] | None = None) -> DataFrame:
    """`rows` with `out` and `hits` (array of (name, match)): the wide rules in order, as placeholders or removed.

    A null text gives an empty one without hits.
    """
    rows = rows.withColumn(out, F.coalesce(F.col(text), F.lit("")))
    steps = []
    for i, (name, pattern) in enumerate(R.WIDE_REDACTIONS):
        if enabled is not None and name not in enabled:
            continue
        p = "(?U)" + pattern
        found = F.transform(F.regexp_extract_all(F.col(out), F.lit(p), 0), _named(name))
        rows = rows.withColumn(f"_h{i}", found)
        by = f" __{name}__ " if placeholder else " "
        if name == "NAMA_WP":  # the label stays, its spaces at the ends do not
            by = "$1 NAMA_WP" if placeholder else "$1"
        rows = rows.withColumn(out, _sub(F.col(out), pattern, by))
        steps.append(f"_h{i}")
    return rows.withColumn("hits", F.concat(*steps) if steps else F.array()).withColumn(out, squeeze(F.col(out))).drop(*steps)


def cut_stop_phrases(text: Column) -> Column:
    return _pairs_squeezed(_sub(F.coalesce(text, F.lit("")), "(?i)" + "|".join(f"(?:{p})" for p in R.STOP_PHRASES), " "))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\w+\b"), 0)


def drop_stop_words(words: Column, stop: list[str] = R.STOP_WORDS, keep: list[str] = R.KEEP_WORDS) -> Column:
    """Without stop words; what is to keep stays even if it is one."""
    return F.filter(words, lambda t: F.lower(t).isin(keep) | ~F.lower(t).isin(stop))


def _is_placeholder(t: Column, style: str) -> Column:
    """Double underscores in capitals, as documented, or the single ones in lower case that the normaliser leaves."""
    return t.startswith("__PH_") & t.endswith("__") if style == "documented" else t.startswith("_ph_") & t.endswith("_")


def syntactic_tokens(text_norm: Column, stop_words: bool = True, min_length: int = 2, placeholders_first: bool = True, stop_phrases: bool = True, style: str = "documented") -> Column:
    """Tokens for the syntactic features: stop phrases cut, short tokens and stop words dropped, placeholders moved to the front."""
    t = _strip(F.coalesce(text_norm, F.lit("")))
    words = tokens(cut_stop_phrases(t) if stop_phrases else t)
    words = F.filter(words, lambda w: F.length(w) >= min_length) if min_length > 1 else words
    if stop_words and placeholders_first:
        return F.concat(F.filter(words, lambda w: _is_placeholder(w, style)), drop_stop_words(F.filter(words, lambda w: ~_is_placeholder(w, style))))
    return drop_stop_words(words) if stop_words else words


def placeholder_words(text: Column, style: str = "documented") -> Column:
    """Placeholders as words: ph_ and the lower-cased name."""
    if style != "documented":
        return _sub(text, r"\b_(ph_[a-z0-9_]*[a-z0-9])_+\b", "$1")
    # Only the matched name is lowered: split at the matches, lower every second part.
    parts = F.split(_sub(text, r"__PH_([A-Z0-9_]+)__", "\u0001$1\u0001"), "\u0001")
    lowered = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("ph_"), F.regexp_replace(F.regexp_replace(F.lower(p), "_+", "_"), "^_|_$", ""))).otherwise(p))
    return F.regexp_replace(F.array_join(lowered, ""), r"ph_(?![a-z0-9_])", "ph")


def tidy_lines(text: Column) -> Column:
    """Spaces and tabs as one space, at most two line ends in a row."""
    t = F.regexp_replace(text, "\u00a0", " ")
    return _strip(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"))


def truncate(text: Column, max_chars: int, mode: str = "head_tail") -> Column:
    """A text cut to max_chars characters: head, tail, or both around an ellipsis; none and non-positive limits leave it."""
    if max_chars is None or max_chars <= 0 or mode not in ("head", "tail", "head_tail"):
        return text
    right, left = lambda t: _sub(t, r"\s+$", ""), lambda t: _sub(t, r"^\s+", "")
    head = right(F.substring(text, 1, max_chars))
    keep = max_chars - 3
    if mode == "tail":
        cut = left(F.right(text, F.lit(max_chars)))
    elif mode == "head" or keep <= 10:
        cut = head
    else:
        cut = _strip(F.concat(right(F.substring(text, 1, keep // 2)), F.lit(" \u2026 "), left(F.right(text, F.lit(keep - keep // 2)))))
    return F.when(F.char_length(text) <= max_chars, text).otherwise(cut)


def semantic_text(text_norm: Column, stop_phrases: bool = True, convert: bool = True, mode: str = "head_tail", max_chars: int = 2000, style: str = "documented") -> Column:
    """Text for embeddings: stop phrases cut, placeholders as words, lines tidied, cut to length."""
    t = F.coalesce(text_norm, F.lit(""))
    t = cut_stop_phrases(t) if stop_phrases else t
    t = placeholder_words(t, style) if convert else t
    return truncate(tidy_lines(t), max_chars, mode)


def tfidf_text(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces."""
    t = squeeze(F.lower(F.coalesce(text, F.lit(""))))
    return squeeze(F.regexp_replace(t, r"[^a-z0-9 ]", " "))


#: The parts of a templated description, in order. Fixed values.
TEMPLATE = [
    ("modul", "MODUL"), ("sub_modul", "SUB MODUL"), ("jenis_masalah", "JENIS MASALAH"), ("judul_masalah", "JUDUL MASALAH"),
    ("data", "DATA"), ("jenis_data", "JENIS DATA"), ("isi_permasalahan", "ISI PERMASALAHAN"),
]


def template_parts(text: Column) -> dict[str, Column]:
    """Name to value of each part of a templated description; null for all where the template does not fit."""
    gaps = r"\s*".join(rf"{label}:\s*(.*{'?' if i < len(TEMPLATE) - 1 else ''})" for i, (_, label) in enumerate(TEMPLATE))
    pattern = "(?isU)" + gaps
    fits = text.rlike(pattern)
    return {name: F.when(fits, _strip(F.regexp_extract(text, pattern, i + 1))) for i, (name, _) in enumerate(TEMPLATE)}


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+"))


def report_tokens(text: Column) -> Column:
    """Tokens of the frequency reports: Latin letters and digits, without stop words and plain numbers."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-zA-Záéíóúàèìòùâêîôûäëïöüñç\s]", " ")
    words = F.array_remove(F.split(clean, r"\s+"), "")
    return F.filter(words, lambda w: ~w.isin(R.REPORT_STOP_WORDS) & ~w.rlike(r"(?U)^\d+$"))


def bigrams(words: Column, min_length: int = 2) -> Column:
    """Neighbouring words of one text, both of at least min_length characters, joined by a space."""
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), after, lambda a, b: F.when((F.length(a) >= min_length) & (F.length(b) >= min_length), F.concat_ws(" ", a, b)))
    return F.filter(pairs, lambda p: p.isNotNull())


def short_label(text: Column, most: int = 42) -> Column:
    """A label of at most `most` characters, with an ellipsis where it was longer."""
    t = _strip(F.coalesce(text, F.lit("")))
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(_sub(F.substring(t, 1, most - 3), r"\s+$", ""), F.lit("...")))


def decode_tokens(value: Column) -> Column:
    """Tokens from a JSON list, or from blank-separated text where it is none; null and blank have none."""
    parsed = F.from_json(value, "array<string>")
    plain = F.array_remove(F.split(_strip(F.coalesce(value, F.lit(""))), r"\s+"), "")
    return F.when(F.ltrim(value).startswith("["), F.coalesce(parsed, plain)).otherwise(plain)
