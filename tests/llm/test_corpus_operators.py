"""Each corpus operator against brute force on small tables that hold nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

WORDS = ["alpha", "beta", "gamma", "delta", "éta", "the", "of", "and", "MIT", "license", "Apache", "general", "public", "zeta", "omega", "12", "x"]


def _texts():
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))
    passage = " ".join(f"w{i}{r.randrange(99)}" for i in range(40))
    out = [None, "", "   \n", "one", "two words", prose(30), prose(60), prose(400)]
    out += [out[6], out[6], out[6] + " more", "start " + passage + " end", prose(25) + passage, passage.upper() + prose(12), "é" * 150, "ü" + "é" * 150]
    out += ["Released under the MIT License.", "the Apache License, Version 2.0 and the GNU General Public License, version 3.", "mit-license MIT LICENSE", "long " + prose(20_000)]
    return list(enumerate(out))


CLASHES = ["h", "ws", "fp", "key", "part", "kind", "row", "size", "target", "n", "hits", "id", "blob", "rank", "shard", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None) for i, t in _texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# ---- 1 SimHash ---------------------------------------------------------------------------------------------------
def _simhash(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def _components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark, docs, nothing):
    from reprise.llm.simhash import simhash_groups

    found = {r["doc_id"]: r for r in simhash_groups(docs).collect()}
    fps = {i: _simhash(t) for i, t in _texts()}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == fps
    assert {i: r["component_id"] for i, r in found.items()} == _components(fps)
    assert simhash_groups(nothing).count() == 0
    twice = docs.union(docs)
    assert simhash_groups(twice).count() == 2 * docs.count()


def test_links_lose_nothing_in_large_buckets(monkeypatch):
    from reprise.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET", 4)
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 5))) for _ in range(120)} | {r.getrandbits(64) for _ in range(40)}
    rows = []
    for fp in fps:
        for k in range(66):
            p, low = k % 33, k < 33
            seg = fp & 0xFFFFFFFF if low else fp >> 32
            held = seg & ~(1 << p) if p < 32 else seg
            free = (0xFFFFFFFF << 32 if low else 0xFFFFFFFF) | ((1 << p if low else 1 << (p + 32)) if p < 32 else 0)
            rows.append(((k << 32) | held, fp, free))
    edges = set()
    for _ in range(40):
        rows.sort()
        signed = lambda c: pa.array(np.array(c, dtype=np.uint64).view(np.int64))
        batches = [pa.RecordBatch.from_arrays([signed(c) for c in zip(*rows[i : i + 97])], ["key", "fp", "free"]) for i in range(0, len(rows), 97)]
        rows = []
        for out in simhash._link(iter(batches)):
            for s, d, k, f in zip(*(c.to_pylist() for c in out.columns)):
                u = lambda v: v & (2**64 - 1)
                if k is None:
                    edges.add((u(s), u(d)))
                else:
                    rows.append((u(k), u(s), u(f)))
        if not rows:
            break
    assert not rows
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    want = _components({f: f for f in fps})
    up = {f: f for f in fps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == want


def test_near_duplicates_keep_exact_copies_together(docs):
    from reprise.llm.simhash import near_duplicate_groups

    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(docs).collect()}
    assert got[8] == got[9] == got[6] == 6 and got[7] == 7


def test_near_duplicates_are_those_of_the_required_similarity(spark):
    from reprise.llm.simhash import near_duplicate_groups

    r = random.Random(11)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], {}
    for i in range(40):
        one = [f"w{r.randrange(3000)}" for _ in range(200)]
        two = list(one)
        for p in range(1 + i % 8):
            two[20 * p + 20] = f"x{r.randrange(3000)}"
        a, b = shingles(one), shingles(two)
        want[2 * i + 1] = 2 * i if len(a & b) / len(a | b) >= 0.8 else 2 * i + 1
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    got = {x["doc_id"]: x["component_id"] for x in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == want and len(set(want.values()) & set(want)) == 20


def test_near_duplicates_of_a_large_group(spark, nothing):
    from reprise.llm.simhash import near_duplicate_groups

    r = random.Random(5)
    one = [f"w{r.randrange(3000)}" for _ in range(300)]
    rows = [(i, " ".join(one[: 10 * (i % 25)] + [f"x{i}"] + one[10 * (i % 25) + 1 :])) for i in range(300)]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("component_id").distinct().collect()[0][0] == 0 and got.count() == 300
    assert near_duplicate_groups(nothing).count() == 0


def test_near_duplicates_of_shared_and_null_ids(spark, docs, nothing):
    from reprise.llm.simhash import drop_near_duplicates, near_duplicate_groups

    r = random.Random(12)
    one, two, three = (" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(3))
    rows = [(7, one), (7, two), (7, three), (None, one + " more"), (None, "alone " * 9), (None, "alone " * 9), (9, two), (9, two), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long").repartition(3)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str)
    assert got == sorted([(7, one), (7, two), (7, three), (None, "alone " * 9), (3, None)], key=str)
    assert drop_near_duplicates(df.where("doc_id = 9")).count() == 1
    assert near_duplicate_groups(df).where("component_id IS NULL").count() == 2
    assert drop_near_duplicates(nothing).count() == 0
    assert drop_near_duplicates(docs).columns == docs.columns


# ---- 2 languages -------------------------------------------------------------------------------------------------
def test_languages(spark, nothing):
    from reprise.llm.langid import fit_languages, identify_languages

    r = random.Random(1)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oi", "que"]}
    speak = lambda c, n: " ".join("".join(r.choice(sounds[c]) for _ in range(r.randrange(2, 5))) for _ in range(n))
    rows = [(i, speak(c, 60), c) for i in range(90) for c in sounds]
    rows += [(1000, None, "aa"), (1001, "  12 !", "bb"), (1002, speak("cc", 5000), None)]
    df = spark.createDataFrame([(i, t, c) for i, (_, t, c) in enumerate(rows)], "doc_id long, text string, lang string")
    model = fit_languages(df, F.col("doc_id") % 4 != 2)
    got = {x["doc_id"]: x for x in identify_languages(df, model).collect()}
    wrong = sum(got[i]["lang_pred"] != c for i, (_, t, c) in enumerate(rows) if c and t and re.search("[a-z]", t))
    assert wrong == 0 and got[len(rows) - 1]["lang_pred"] == "cc"
    assert got[len(rows) - 3]["lang_pred"] == got[len(rows) - 2]["lang_pred"] == "und"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    odd = spark.createDataFrame([(1, "½ ² ①", "x"), (2, "Ⅷ 12", "x"), (3, "", "x"), (4, "kaloka lomi", "x"), (4, "kaloka lomi", "x")], "doc_id long, text string, score string")
    found = {x["doc_id"]: x["lang_pred"] for x in identify_languages(odd, model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "aa"} and identify_languages(odd, model).count() == 5
    copies = spark.createDataFrame([(speak("aa", 60), "aa")] * 3000 + [(speak("bb", 60), "bb") for _ in range(60)] + [(speak("aa", 60), "aa")], "text string, lang string")
    starved = fit_languages(copies, F.lit(True), rows_per_lang=16)
    assert all(len(content) > 300 for _, content in starved.contents)
    empty = fit_languages(nothing, F.lit(True))
    assert identify_languages(df, empty).select("lang_pred").distinct().collect()[0][0] == "und"
    assert identify_languages(nothing, model).count() == 0


# ---- 3 syncmers --------------------------------------------------------------------------------------------------
def test_syncmers(spark, docs, nothing):
    from reprise.llm.syncmers import anchors, fingerprint_edits

    got = {r["doc_id"]: r for r in fingerprint_edits(docs, 5).collect()}
    texts = [t or "" for _, t in _texts()]
    for i, t in enumerate(texts):
        nxt, q = texts[(i + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[8]["fingerprint"] and got[8]["near_next"] == 1.0
    assert got[7]["near_edited"] > 0.5 > got[7]["near_next"]
    assert fingerprint_edits(nothing, 4).count() == 0
    long = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(long,), ("ö start " + long,), (None,), ("few",)], "t string").select(anchors(F.col("t")).alias("a")).collect()
    one, two = [{(x["pos"], x["hash"]) for x in r["a"]} for r in rows[:2]]
    assert {(p + 8, h) for p, h in one} <= two and len(two) - len(one) <= 8  # anchors move with their characters
    assert 0.3 < len(one) / len(long) < 0.5 and rows[2]["a"] == [] and len(rows[3]["a"]) == 1


def _anchors(text):
    """Closed syncmers by brute force: (place, characters)."""
    h = lambda t: xxhash.xxh64_intdigest(t.encode("utf-32-be"), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode("utf-32-be"), 42) >> 63)
    if len(text) < 12:
        return [(0, text)] if text else []
    inner = [h(text[i : i + 8]) for i in range(len(text) - 7)]
    return [(i, text[i : i + 12]) for i in range(len(text) - 11) if min(inner[i], inner[i + 4]) <= min(inner[i + 1 : i + 4])]


def _links(text):
    from collections import Counter

    a = _anchors(text)
    return Counter((t, *((a[i + 1][1], a[i + 1][0] - p) if i + 1 < len(a) else ())) for i, (p, t) in enumerate(a))


def test_syncmers_against_brute_force(spark):
    from reprise.llm.syncmers import anchors, fingerprint_edits

    r = random.Random(2)
    prose = lambda n: " ".join(f"w{r.randrange(50_000)}" for _ in range(n))
    passage = prose(300)
    texts = [prose(2000) + " " + passage, prose(400) + " " + passage + " " + prose(500), "a b c d e f g " * 50, "a b c d e f g " * 20, None, "é漢😀" * 30, "short"]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)), "one quite short line of eight small words", "", passage, passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("prints", F.lit("clash"))
    found = df.orderBy("doc_id").select(anchors(F.col("text")).alias("a")).collect()
    plain = [t or "" for t in texts]
    for t, row in zip(plain, found):
        if max(map(ord, t), default=0) < 0x10000:
            assert [x["pos"] for x in row["a"]] == [p for p, _ in _anchors(t)]
    got = {x["doc_id"]: x for x in fingerprint_edits(df, 3).collect()}
    alike = lambda a, b: 2 * (a & b).total() / (a.total() + b.total()) if a or b else 1.0
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[i]["near_next"] == pytest.approx(alike(_links(t), _links(after))), i
        assert got[i]["near_edited"] == pytest.approx(alike(_links(t), _links(edited))), i
        for j in range(i):
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (t == plain[j])
            assert (got[j]["edited_fingerprint"] == got[i]["fingerprint"]) == (got[j]["edited_sha256"] == hashlib.sha256(t.encode()).hexdigest())
    assert got[0]["near_next"] > 0.1 and got[7]["near_edited"] > 0.7 and got[8]["near_edited"] > 0.5 and got[10]["near_next"] == 1.0


# ---- 4 repeats ---------------------------------------------------------------------------------------------------
def _removed(texts):
    seen, out = {}, {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            else:
                seen[w] = i
        out[i] = (len(b), bytes(x for x, c in zip(b, cover) if not c), sum(1 for p in range(len(b)) if cover[p] and (not p or not cover[p - 1])))
    return out


def test_repeats(spark, docs, nothing):
    from reprise.llm.repeats import remove_repeats

    want = _removed(_texts())
    for r in remove_repeats(docs).collect():
        n, kept, spans = want[r["row"]["doc_id"]]
        assert (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) == (n, kept, spans)
    text = {r["row"]["doc_id"]: r["kept"] for r in remove_repeats(docs, as_text=True).collect()}
    assert text[5] == _texts()[5][1] and text[8] == ""
    assert remove_repeats(nothing).count() == 0


def test_repeats_of_a_line_in_many_contexts(spark):
    from reprise.llm.repeats import MANY, remove_repeats

    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghij klmno") for _ in range(n))
    line, passage = noise(60), noise(150)
    texts = [(i, noise(r.randrange(80, 140)) + r.choice([line, passage, line + passage]) + noise(r.randrange(80, 140))) for i in range(MANY + 150)]
    texts += [(9000 + i, line * 40 + noise(5)) for i in range(3)]
    want = _removed(texts)
    for x in remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(7)).collect():
        assert (x["n_bytes"], bytes(x["kept"]), len(x["spans"])) == want[x["row"]["doc_id"]]


def test_repeats_of_shared_and_null_ids(spark):
    from reprise.llm.repeats import remove_repeats

    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghij klmno") for _ in range(n))
    passage = noise(150)
    texts = [(2, noise(40) + passage), (2, noise(300)), (1, passage), (None, noise(200)), (None, noise(220)), (5, passage + "x"), (5, passage + "x"), (6, noise(30))]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, tie int").withColumn("id", F.lit("clash"))
    got = {x["row"]["tie"]: bytes(x["kept"]).decode() for x in remove_repeats(df.repartition(3)).collect()}
    assert got == {0: texts[0][1][:40], 1: texts[1][1], 2: passage, 3: texts[3][1], 4: texts[4][1], 5: "x", 6: "x", 7: texts[7][1]}


def test_run_index():
    from reprise.llm.runindex import WINDOW, RunIndex

    r = random.Random(2)
    base = bytes(r.choice(b"ab") for _ in range(150))
    strings = [base, base[10:160] + b"zz", base[5:], bytes(r.choice(b"ab") for _ in range(130)), b"a" * 177, b"a" * 120]
    index = RunIndex(strings)
    assert len(index.heads) == len(index.tops) == len(index.bottoms) < sum(map(len, strings))
    whole = b"".join(s + bytes([1 + k]) for k, s in enumerate(strings))  # marks in the order of the strings, below all else
    suffixes = sorted(range(len(whole)), key=lambda i: whole[i:])
    lengths = index.matching_lengths()
    for above, i in zip(suffixes, suffixes[1:]):
        n = 0
        while whole[above + n : above + n + 1] == whole[i + n : i + n + 1] != b"":
            n += 1
        assert lengths[i] == n
    string, place, match = index.stream()
    classes = {}
    for s, p, m in zip(string, place, match):
        classes.setdefault(m, set()).add(strings[s][p : p + WINDOW])
    assert all(len(v) == 1 for v in classes.values()) and len(set.union(*classes.values())) == len(classes)
    assert len(string) == sum(max(0, len(s) - WINDOW + 1) for s in strings)


# ---- 5 URLs ------------------------------------------------------------------------------------------------------
def test_urls(spark):
    from reprise.llm.queries import URL_RULES
    from reprise.llm.urlfilter import judge_urls

    urls = [None, "", "no scheme", "http://Example.COM/en/1", "https://www.example.com/en/x?q#f", "http://a.b.net/es/", "http://net/fr/1", "http://example.com", "http://badexample.com/en/", "x://y://z/en/", "http://com/", "http://.net/es/q", "http://www.example.com/en/" + "p/" * 3000] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("u", F.lit(1))

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    clash = pages.withColumns({c: F.lit("own") for c in ("best", "h0", "e", "td", "k", "d", "row", "rl")})
    found = judge_urls(clash, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    assert found.where("best = 'own' AND k = 'own' AND row = 'own'").count() == len(urls)
    assert judge_urls(pages.where("false"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert judge_urls(pages, none).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


# ---- 6 mixing ----------------------------------------------------------------------------------------------------
def test_apportion_is_sainte_lague(spark):
    from reprise.llm.mixing import apportion

    r = random.Random(4)
    for n in (0, 1, 7, 50, 1000):
        votes = [r.choice([0, 1, 5, 5, 30, 400, 1000.5]) for _ in range(12)]
        df = spark.createDataFrame([(f"p{i:02}", float(v), n) for i, v in enumerate(votes)], "p string, v double, n long")
        got = {x["p"]: x["quota"] for x in apportion(df, "n", "v", ["p"], []).collect()}
        seats = dict.fromkeys(got, 0)
        for _ in range(n):
            best = max((p for p in seats if votes[int(p[1:])] > 0), key=lambda p: (votes[int(p[1:])] / (2 * seats[p] + 1), -int(p[1:])))
            seats[best] += 1
        assert got == seats


def _mixed_by_blocks(docs, shard_words, fan, block=16):
    """Lays out each shard's line word by word and takes the blocks that the seeded permutation ranks first."""
    from reprise.llm.mixing import _PRIMES, mix_sources

    got = {r["doc_id"]: r for r in mix_sources(docs, shard_words=shard_words, fan=fan).collect()}
    total = docs.select("source", F.xxhash64(F.lit(17), "doc_id", "text").alias("h"), "doc_id").collect()
    by = {}
    for r in total:
        size = got[r["doc_id"]]["size"]
        n = max(1, -(-got[r["doc_id"]]["source_size"] // shard_words))
        by.setdefault((r["source"], (r["h"] >> 20) % n), []).append((r["h"], r["doc_id"], size))
    spark = docs.sparkSession
    for (source, shard), rows in by.items():
        line = [i for h, i, size in sorted(rows) for _ in range(size)]
        cells = -(-len(line) // block)
        taken = sum(got[i]["taken"] for _, i, _ in rows)
        key = spark.range(1).select(F.xxhash64(F.lit(18), F.lit(source or ""), F.lit(source is None), F.lit(shard).cast("long"))).first()[0]
        for quota in range(2 * cells + 1):  # the quota is what explains the shard's sum
            passes, rest = divmod(quota, cells) if cells else (0, 0)
            prime = _PRIMES[key % len(_PRIMES)]
            picked = {b for b in range(cells) if (prime * b + (key >> 8) % cells) % cells < rest}
            count = {i: passes * size for _, i, size in rows}
            for at, i in enumerate(line):
                count[i] += at // block in picked
            if sum(count.values()) == taken and count == {i: got[i]["taken"] for _, i, _ in rows}:
                break
        else:
            raise AssertionError((source, shard))


def test_mixing(docs, nothing):
    from reprise.llm.mixing import mix_sources

    rows = mix_sources(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in _texts()}
    source = {i: f"s{i % 3}" if i % 5 else None for i, _ in _texts()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    by = {}
    for r in rows:
        by.setdefault(source[r["doc_id"]], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    weights = dict(zip(["s0", "s1", "s2", None], [5, 2, 1, 5]))
    total = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    full, goal = set(), 1.5 * sum(total.values())
    while True:
        left = goal - sum(2 * total[s] for s in full)
        share = {s: left * weights[s] / sum(weights[t] for t in by if t not in full) for s in by if s not in full}
        over = {s for s, v in share.items() if v > 2 * total[s]}
        if not over:
            break
        full |= over
    for s, rs in by.items():
        target = 2 * total[s] if s in full else share[s]
        assert rs[0]["target"] == pytest.approx(target) and rs[0]["source_size"] == total[s]
        assert abs(sum(r["taken"] for r in rs) - target) <= 64
    for shard_words, fan in ((500, 4), (3000, 1024)):
        _mixed_by_blocks(docs, shard_words, fan)
    assert sorted(map(tuple, mix_sources(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mix_sources(nothing).count() == 0


# ---- 7 toxicity --------------------------------------------------------------------------------------------------
def test_toxicity(spark, nothing):
    from reprise.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity

    r = random.Random(6)
    word = lambda: "".join(r.choice(["an", "er", "tion", "he", "or", "st", "ing"]) for _ in range(r.randrange(1, 4)))
    rude = ["blockhead", "nitwit", "scoundrel"]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(r.choice(rude) if bad and r.random() < 0.06 else word() for _ in range(150)), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = fit_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {x["doc_id"]: x for x in score_toxicity(docs, model).collect()}
    test = [(got[i]["predicted"], y) for i, _, y in rows if held(i)]
    assert sum(p == y for p, y in test) / len(test) > 0.9
    long = spark.createDataFrame([(1, " ".join(word() for _ in range(60_000))), (1, " ".join(word() for _ in range(30_000)) + " nitwit blockhead" * 400)] * 2, "doc_id long, text string")
    assert [x["score"] > 0.5 for x in score_toxicity(long, model).orderBy("score").collect()] == [False, False, True, True]
    assert got[900]["score"] == got[901]["score"] < 0.5 and got[900]["worst"] is None
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 2 and kept.count() < 340
    flat = fit_toxicity(docs, labels.where("toxic = 0"), F.lit(True))
    assert score_toxicity(docs, flat).where("predicted = 1").count() == 0
    assert score_toxicity(nothing, fit_toxicity(nothing, labels, F.lit(True))).count() == 0


# ---- 8 tokens ----------------------------------------------------------------------------------------------------
def test_tokens(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    from reprise.llm.tokencount import _Encoder, count_tokens

    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(definition)
    want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in _texts()}
    got = {r["doc_id"]: r for r in count_tokens(docs, definition, cache_bytes=2000, entries=10).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == want
    assert all(r["n_bytes"] == len((_texts()[i][1] or "").encode()) and r["over_limit"] == (want[i] > 1024) for i, r in got.items())
    assert count_tokens(nothing, definition).count() == 0
    assert count_tokens(docs.union(docs), definition).count() == 2 * len(want)
    long = spark.createDataFrame([(1, "x" * 300_000)], "doc_id long, text string")
    assert count_tokens(long, definition).collect()[0]["n_tokens"] == len(library.encode("x" * 300_000, add_special_tokens=False))
    encoder, r = _Encoder(definition, {}, 5000), random.Random(1)
    for _ in range(500):
        t = "".join(r.choice("ab Z'sté\x1c\x1d\x85\u00a0\u3000\t\n  12٣\U0001f600<|endoftext|>") for _ in range(r.randint(0, 30))) + r.choice(["", "<|endoftext|>", " 's"])
        assert encoder.count(t) == len(library.encode(t, add_special_tokens=False)), repr(t)


# ---- 9 decontamination, 10 licenses ------------------------------------------------------------------------------
def _alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, docs, nothing):
    from reprise.llm.decontam import decontaminate, drop_contaminated, find_passages

    texts = dict(_texts())
    passage = texts[11].split(" ", 1)[1].rsplit(" ", 1)[0]
    items = [(1, passage), (2, "Two, words!"), (3, None), (4, "..."), (5, " ".join(passage.split()[3:12])), (10, "the of and " * 6), (10, "one"), (7, "unseen words only here")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    want = {}
    for i, t in texts.items():
        w, hit, found = _alnum(t), set(), set()
        for k, b in items:
            iw = _alnum(b)
            n = min(10, len(iw))
            for s in range(max(1, len(iw) - 9)) if iw else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(k))
        want[i] = (len(w), len(hit), sorted(found))
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == want
    assert decontaminate(docs.union(docs), bench).where("n_hit > 0").count() == 2 * sum(v[1] > 0 for v in want.values())
    kept = drop_contaminated(docs.union(docs), bench)
    assert kept.columns == docs.columns and kept.count() == 2 * sum(v[1] == 0 for v in want.values())
    assert decontaminate(nothing, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).where("n_hit > 0").count() == 0 and decontaminate(docs, none).count() == len(texts)
    assert find_passages(docs, bench).where("size(hits) > 0").count() == sum(v[1] > 0 for v in want.values())


def test_proximity_matches(spark):
    from reprise.llm.decontam import find_passages

    r = random.Random(3)
    noise = lambda n: [f"n{r.randrange(9999)}" for _ in range(n)]
    item = [f"b{i}" for i in range(40)]
    changed = [f"x{i}" if i % 8 == 7 else w for i, w in enumerate(item)]
    dropped = [w for i, w in enumerate(item) if i % 8 != 7]
    longer = [x for i, w in enumerate(item) for x in ([w, f"y{i}"] if i % 8 == 7 else [w])]
    texts = [noise(50) + edit + noise(50) for edit in (changed, dropped, longer)] + [noise(200), item[:4] + noise(6), list(reversed(item)), noise(3) + item]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {x["row"]["doc_id"]: x for x in find_passages(docs, bench).collect()}
    assert all(not got[i]["hits"] and got[i]["near"] for i in range(3))
    assert all(not got[i]["hits"] and not got[i]["near"] for i in (3, 4, 5))
    assert len(got[6]["hits"]) == 31 and not got[6]["near"]
    for i in range(3):  # brute force over the windows that the hits name
        for h in got[i]["near"]:
            window = item[h["item_start"] : h["item_start"] + 10]
            assert h["matched"] == sum(w in texts[i][max(0, h["doc_start"] + k - 2) : max(0, h["doc_start"] + k + 3)] for k, w in enumerate(window)) >= 8


def test_licenses(spark, docs, nothing):
    from reprise.llm.license import _indexed, scan_licenses, templates
    from reprise.llm.licensetexts import GPL_3, MIT

    r = random.Random(8)
    noise = lambda n: " ".join(f"n{r.randrange(999)}" for _ in range(n))
    more = [MIT, noise(30) + " Copyright 2020 " + MIT + noise(5), MIT.replace("Software", "Program"), "# SPDX-License-Identifier: GPL-3.0-or-later", GPL_3.replace("hope", "great hope") + MIT, " ".join(MIT.split()[:20]) + noise(80), "Licensed under CC BY-NC 4.0."]
    texts = _texts() + [(100 + i, t) for i, t in enumerate(more)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(texts[len(_texts()) :], "doc_id long, text string"))
    known = templates()
    ws = {i: _alnum(t) for i, t in texts}
    df = {w: sum(w in x for x in map(set, ws.values())) for _, words, _, _ in known for w in words}
    index = _indexed(known, df, 8)
    by_idf = sorted({known[u][1][k] for u, ks, _, _ in index for k in ks}, key=lambda w: (df[w], w))
    keys = {known[u][1][a] for u, _, a, _ in index}

    def brute(w):
        looked = {x for x in [y for y in by_idf if y in set(w)][:64]} | (keys & set(w))
        for u, places, _, o in index:
            label, t, phrase, base = known[u]
            for s in range(len(w) - len(phrase) + 1):
                if w[s : s + len(phrase)] == phrase:
                    near = sum(t[k] in looked and t[k] in w[max(0, s - o + k - 8) : max(0, s - o + k + 9)] for k in places)
                    if base or near / len(places) >= 0.5:
                        yield label, base, s, round(near / len(places), 9)

    got = {x["row"]["doc_id"]: x for x in scan_licenses(rows).collect()}
    for i, w in ws.items():
        assert got[i]["n_words"] == len(w)
        assert sorted((m["label"], m["base"], m["start"], round(m["score"], 9)) for m in got[i]["matches"]) == sorted(brute(w)), i
    labels = {i: {m["label"] for m in got[i]["matches"]} for i in ws}
    assert all("mit-text" in labels[i] for i in (100, 101, 104)) and "mit-text" not in labels[105]
    assert labels[103] >= {"spdx:GPL-3.0-or-later"} and labels[104] >= {"gpl-3.0-notice", "gpl"} and labels[106] == {"cc-by-nc-4.0"}
    assert scan_licenses(nothing).count() == 0
    assert scan_licenses(docs.union(docs)).count() == 2 * docs.count()


def _oracle(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    out = con.sql(sql)
    return sorted((dict(zip(out.columns, row)) for row in out.fetchall()), key=str)


def test_queries_agree_with_their_sql(spark, docs, tmp_path):
    from reprise.llm import queries

    tables = {
        "documents": docs.select("doc_id", "text", "lang", "source").union(docs.where("doc_id > 8").select("doc_id", "text", "lang", "source")),
        "benchmark": spark.createDataFrame([("a", _texts()[7][1][:300]), ("b", "two words"), ("c", None), ("c", "zeta")], "item_id string, text string"),
        "pages": spark.createDataFrame([(1, "http://www.Example.com/en/x"), (1, "http://www.Example.com/en/x"), (2, None), (3, "ftp://a.net/es/?q")], "page_id long, url string"),
    }
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    plain = {name: t.toArrow() for name, t in tables.items()}
    for name, sql in queries.oracle_sql().items():
        got = sorted((r.asDict() for r in queries.queries()[name](spark, str(tmp_path)).collect()), key=str)
        want = _oracle(sql, **plain)
        assert [sorted(r.items()) for r in got] == [sorted(r.items()) for r in want], name


# ---- the pipeline ------------------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice(["an", "er", "tion", "he", "or"]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    shared = prose(80)
    texts = [prose(120) for _ in range(60)]
    texts += [texts[0], texts[1], shared + prose(60), shared + prose(70), "x " + prose(30), None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(texts[5].split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        steps[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert steps["decontamination"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r["doc_id"] for r in steps["near_duplicates"].select("doc_id").collect()}
    assert {60, 61} & ids == set() and {0, 1} <= ids
    cut = {r["doc_id"]: r["text"] for r in steps["repeats"].collect()}
    assert shared in cut[62] and shared[20:-20] not in cut[63]
    assert 5 not in {r["doc_id"] for r in steps["decontamination"].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == steps["mixing"].count()
