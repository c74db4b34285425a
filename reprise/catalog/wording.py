"""Queries: text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.catalog.registry import TEXTS, load, query, texts
from reprise.functions import text as X


def _each(name, column, sql=None):
    """A query of one text column for each document."""
    query(name, f"WITH {TEXTS} SELECT doc_id, {sql} AS value FROM x" if sql else None)(lambda spark, sf: texts(spark, sf).select("doc_id", column(F.col("text")).alias("value")))


_joined = lambda f: lambda t: F.array_join(f(t), " ")

_each("TXT-01", X.strip_control, r"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[\x00-\x1F\x7F-\x{9F}]', ' ', 'g'), '\s{2,}', ' ', 'g'))")
query("TXT-02", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS value FROM pages")(lambda spark, sf: load(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("value")))
_each("TXT-04", X.placeholders)
query("TXT-05")(lambda spark, sf: X.placeholder_counts(texts(spark, sf), "text"))
_each("TXT-06", X.word_forms)
_each("TXT-07", X.standard_terms)
_each("TXT-08", lambda t: X.normalize(t, redact=False, forms=False, terms=False, digits=True), r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\d+', ' ', 'g'), '\s+', ' ', 'g'))")
_each("TXT-09", lambda t: X.drop_short_tokens(t, ("e",)), r"array_to_string(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(w) > 1 OR w = 'e' OR regexp_full_match(w, '\d')), ' ')")
_each("TXT-10", lambda t: X.normalize(t, control=True))
_each("TXT-11", lambda t: X.normalize_first_form(t, redact=True, short=True))


@query("TXT-12")
def redacted(spark, sf):
    return X.redact(texts(spark, sf), "text").select("doc_id", "redacted", F.to_json("counts").alias("counts"))


_each("TXT-13", lambda t: F.array_join(X.token_counts(F.concat(F.coalesce(t, F.lit("")), F.lit(" <NPWP> <NO_PC>"))), ","), "array_to_string(regexp_extract_all(coalesce(text, '') || ' <NPWP> <NO_PC>', '<[A-Z_]+>'), ',')")


@query("TXT-14")
def redacted_wide(spark, sf):
    return X.redact_wide(texts(spark, sf), "text").select("doc_id", "redacted", F.size("hits").alias("n_hits"))


_each("TXT-15", X.cut_stop_phrases)
_each("TXT-16", _joined(lambda t: X.drop_stop_words(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), 0), ["the", "of", "and", "error"], ["error"])), "array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w NOT IN ('the', 'of', 'and')), ' ')")
_each("TXT-17", _joined(X.tokens), r"array_to_string(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), ' ')")
_each("TXT-18", _joined(X.syntactic_tokens))
_each("TXT-20", lambda t: X.placeholder_words(F.concat(F.lit("__PH_NO_WP__ "), F.coalesce(t, F.lit("")))), "'ph_no_wp ' || coalesce(text, '')")
_each("TXT-21", X.tidy_lines, r"trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t\r\f\x0B]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9))")
_each("TXT-22", lambda t: X.truncate(t, 100), r"CASE WHEN length(text) <= 100 THEN text ELSE trim(rtrim(left(text, 48), chr(10) || ' ' || chr(9)) || ' … ' || ltrim(right(text, 49), chr(10) || ' ' || chr(9)), chr(10) || ' ' || chr(9)) END")


@query("TXT-23")
def semantic(spark, sf):
    t = X.semantic_text(X.normalize(F.col("text")))
    rows = texts(spark, sf).select("doc_id", t.alias("text_semantic"))
    return rows.select("doc_id", "text_semantic", F.char_length("text_semantic").alias("n_chars_semantic"), F.size(X.tokens(F.lower("text_semantic"))).alias("n_tokens_semantic"))


_each("TXT-24", X.tfidf_text, r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))")


@query("TXT-25", f"WITH {TEXTS} SELECT doc_id, modul AS p_modul, site AS p_sub, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS p_isi FROM x WHERE text IS NOT NULL")
def templated(spark, sf):
    """Each document is put into the template first, then taken apart."""
    whole = F.concat(F.lit("MODUL: "), "modul", F.lit(" SUB MODUL: "), "site", F.lit(" JENIS MASALAH: a JUDUL MASALAH: b DATA: c JENIS DATA: d ISI PERMASALAHAN: "), "text")
    rows = texts(spark, sf).where("text IS NOT NULL").withColumn("whole", whole)
    p = X.template_parts(F.col("whole"))
    return rows.select("doc_id", p["modul"].alias("p_modul"), p["sub_modul"].alias("p_sub"), p["isi_permasalahan"].alias("p_isi"))


_each("TXT-26", X.word_count, r"CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS INTEGER)")
_each("TXT-27", _joined(X.report_tokens))
_each("TXT-28", lambda t: F.array_join(X.bigrams(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z]+"), 0)), ","), "(SELECT coalesce(string_agg(p, ',' ORDER BY i), '') FROM (SELECT i, ws[i] || ' ' || ws[i + 1] AS p, ws[i] AS a, ws[i + 1] AS b FROM (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws), unnest(range(1, len(ws))) AS u(i)) WHERE length(a) >= 2 AND length(b) >= 2)")
_each("TXT-29", X.short_label, r"(SELECT CASE WHEN length(s) <= 42 THEN s ELSE rtrim(left(s, 39), chr(10) || ' ') || '...' END FROM (SELECT trim(coalesce(text, ''), chr(10) || ' ' || chr(9)) AS s))")
_each("TXT-30", lambda t: F.array_join(X.decode_tokens(F.to_json(F.array(F.lit("a"), F.coalesce(t, F.lit(""))))), "|"), "'a|' || coalesce(text, '')")
