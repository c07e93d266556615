"""Every operator against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirework.llm import (
    decontaminate,
    exact_substrings,
    langid,
    license_scan,
    packing,
    pii,
    quality_knn,
    quality_rules,
    simhash,
    token_counts,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, words int, rid string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def make_texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7))) for _ in range(60)]

    def sentence(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    passage = sentence(120)
    texts = [
        None,
        "",
        " \n\t ",
        "word",
        "Two words",
        sentence(2000),
        passage,
        passage,
        sentence(30) + " " + passage + "\n" + sentence(20),
        passage[:300] + sentence(3) + passage[300:],
        "same line\nsame line\n\nsame line\nother",
        "ab " * 900,
        "A mit license and GNU General PUBLIC license, mit-license; permisson is hereby granted, free of charge, to any persn obtaining a copy",
        "mail a.b@c.org, 10.0.0.1 and 999.1.1.1; 4111 1111 1111 1111 or +49 (30) 1234567. no 1234567890123 x@y",
        "1.2.3.4.5.6.7.8 +1+2+3333333333 0004 @@ a@b@c.de 4111-1111-1111-1112",
        "x" * 5000,
        "éñ" * 700 + "   　z",
        " leading\n\n double  blanks \r\n<|endoftext|> <s> \x00 ▁ end ",
        "don't it's we'll 12,345.67 ##** !!",
    ]
    for _ in range(25):
        t = sentence(rng.randint(5, 260))
        texts += [t] if rng.random() < 0.7 else [t, t.replace(rng.choice(vocab), rng.choice(vocab), 1)]
    return texts


TEXTS = make_texts()
IDS = [*range(len(TEXTS) - 3), 0, None, 3]  # a repeated id, a null id


def rows(texts=None, ids=None):
    texts, ids = TEXTS if texts is None else texts, IDS if ids is None else ids
    return [
        (i, t, None if k % 7 == 0 else ("en", "fr")[k % 2], None, None, "clash", k, "clash")
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]


@pytest.fixture(scope="module")
def docs(spark):
    made = rows()
    return spark.createDataFrame([*made, made[5], made[8]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def every():
    made = rows()
    return [(r[0], r[1] or "") for r in [*made, made[5], made[8]]]


def multiset(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    expected = Counter()
    for i, t in every():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {j + d for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for d in range(3)}
        expected[
            i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w),
        ] += 1
    got = quality_rules.quality_rules(docs, labels)
    assert expected == multiset(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got.where("kept and base_failed").count() == 0
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_binomial_and_certified(spark):
    from math import comb

    cases = [(0, 10), (3, 50), (40, 3000), (100, 12000), (7, 7), (300, 20000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        exact = sum(float(comb(r.n, j)) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1)) if r.n < 1000 else None
        if r.k >= r.n * 0.02:
            assert r.p == 1
        elif exact is not None:
            assert r.p == pytest.approx(exact, rel=1e-9)
        else:
            assert 0 < r.p < 1
    # a cutoff that rejects no good document of many is certified, one that rejects a tenth is not
    stats = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.lit(False).alias("base_failed"),
        *(F.when(F.col("id") % 10 == 0, F.lit(c[1])).otherwise(F.lit(0)).cast("long").alias(s) for _, s, c in quality_rules.RULES),
    )
    cut = quality_rules.certified(stats, stats.select("doc_id")).first()
    for name, _, c in quality_rules.RULES:
        assert cut[f"cut_{name}"] == c[2]


def brute_windows(items):
    wins = defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        k = min(10, len(w))
        if i is not None:
            for j in range(len(w) - k + 1 if w else 0):
                wins[tuple(w[j : j + k])].add(str(i))
    return wins


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 40])
def test_decontaminate(spark, docs, empty, block, monkeypatch):
    words = lower(TEXTS[6]).split()
    items = [
        (10, " ".join(words[20:60])), (9, " ".join(words[25:35])), (2, " ".join(words[40:43])), (7, "word"), (5, ""), (6, None),
        (None, "word"), (11, " ".join(words[5:14])), (12, TEXTS[5][:200]), (13, " ".join(["ab"] * 12)), (14, "zz qq"),
    ]
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins, expected = brute_windows(items), Counter()
    for i, t in every():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hit, named = set(), set()
        for win, owners in wins.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
                    named |= owners
        expected[i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate.decontaminate(docs, bench)
    assert expected == multiset(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_winnow_guarantee():
    rng = np.random.RandomState(1)
    a, b = rng.randint(0, 4, 400), rng.randint(0, 4, 400)
    b[100:110] = a[50:60]
    ha, hb = decontaminate.gram_hashes(a, 5), decontaminate.gram_hashes(b, 5)
    pa_, pb = decontaminate.winnow(ha, 6), decontaminate.winnow(hb, 6)
    at = {int(p) for p in pa_ if 50 <= p <= 55}
    assert any(int(q) - 50 in at for q in pb if 100 <= q <= 105)


def test_license_scan(docs, empty):
    got = license_scan.license_scan(docs)
    expected = Counter()
    for i, t in every():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        found = [
            (j, label)
            for p, label in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl"))
            for j in range(len(w))
            if w[j : j + len(p)] == p
        ]
        at = [j for j, _ in found]
        expected[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    assert expected == multiset(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    row = got.where("doc_id = 12").first()
    assert row.score == 1 and row.labels == "gpl,mit"
    assert [(n.label, n.edits) for n in row.notices if n.edits] == [("mit", 2)]
    assert license_scan.license_scan(empty).count() == 0


def test_fuzzy_notices_find_all_edits():
    rng, notices = random.Random(2), license_scan.Notices()
    for text, label in license_scan.NOTICES:
        for _ in range(20):
            chars = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // license_scan.CHARS_PER_EDIT))):
                j = rng.randrange(1, len(chars) - 1)
                if chars[j] != " ":
                    chars[j] = rng.choice("abcxyz")
            assert label in {x[2] for x in notices.spans(f"some {''.join(chars)} words".encode())}
    assert notices.spans(b"a license for the software of any kind of person") == []


@pytest.mark.parametrize("width,gram,hot,block", [(400, 64, 4096, 16), (60, 12, 4096, 16), (60, 12, 1, 16), (60, 12, 1, 1), (60, 12, 2, 3)])
def test_exact_substrings(docs, empty, width, gram, hot, block, monkeypatch):
    monkeypatch.setattr(exact_substrings, "BLOCK", block)
    raws = [(i, t.encode()) for i, t in every()]
    count = Counter(t[j : j + width] for _, t in raws for j in range(len(t) - width + 1))
    expected = Counter()
    for i, t in raws:
        cover = bytearray(len(t))
        for j in range(len(t) - width + 1):
            if count[t[j : j + width]] > 1:
                cover[j : j + width] = b"\1" * width
        kept = bytes(c for c, x in zip(t, cover, strict=True) if not x)
        spans = len([x for x in bytes(cover).split(b"\0") if x])
        expected[i, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = exact_substrings.exact_substring_dedup(docs, width, gram, hot)
    assert expected == multiset(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert exact_substrings.exact_substring_dedup(empty, width, gram, hot).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    t = Tokenizer.from_file(path)
    got = packing.best_fit_packing(docs, path).collect()
    bins, pieces = defaultdict(list), Counter()
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    expected = Counter()
    for i, text in every():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        s, e, k = 0, len(ids) % 1024 or min(1024, len(ids)), 0
        while s < len(ids):
            expected[i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
            s, e, k = e, e + 1024, k + 1
    assert pieces == expected
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.best_fit_packing(empty, path).count() == 0


def test_pack_histogram_is_tight():
    rng = random.Random(3)
    for _ in range(30):
        sizes = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 60)))
        bins = packing.pack_histogram(sizes, 40)
        used = Counter()
        for fill, times in bins:
            assert sum(fill) <= 40
            for s in fill:
                used[s] += times
        assert used == sizes
        total = sum(s * n for s, n in sizes.items())
        assert sum(n for _, n in bins) <= -(-total // 40) + 1 or sum(n for s, n in sizes.items() if s > 20) > total // 40


def test_pack_histogram_reaches_the_bound():
    rng = random.Random(8)
    for copies in (1, 1000):
        sizes = Counter(min(1024, int(rng.lognormvariate(6, 0.9)) + 1) for _ in range(1500))
        sizes = {s: n * copies for s, n in sizes.items()}
        used = Counter()
        bins = packing.pack_histogram(sizes)
        for fill, times in bins:
            assert sum(fill) <= 1024
            for s in fill:
                used[s] += times
        assert used == sizes
        need, plain = sum(n for _, n in bins), sum(n for _, n in packing.best_fit_decreasing(sizes, 1024))
        assert packing.least_sequences(sizes, 1024) <= need <= plain
        if copies == 1:
            assert need == packing.least_sequences(sizes, 1024)
    # one sequence at a time gives the same number
    for _ in range(50):
        sizes, gaps = Counter(rng.randint(1, 30) for _ in range(60)), []
        for s in sorted(sizes.elements(), reverse=True):
            gaps.sort()
            at = next((i for i, g in enumerate(gaps) if g >= s), None)
            gaps = [*gaps, 30 - s] if at is None else [*gaps[:at], gaps[at] - s, *gaps[at + 1 :]]
        assert sum(n for _, n in packing.best_fit_decreasing(sizes, 30)) == len(gaps)


def brute_prints(texts):
    import xxhash

    table, out = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(table))
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash(docs, empty):
    made = every()
    prints = brute_prints([t for _, t in made])
    group = list(range(len(made)))
    for a in range(len(made)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, made, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    expected = Counter((i, p, least[g]) for g, p, (i, _) in zip(group, prints, made, strict=True))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert expected == got
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("cell", [50_000, 20])
def test_links_lose_nothing(spark, cell):
    rng = np.random.RandomState(4)
    centre = rng.randint(0, 1 << 62, 40).astype(np.uint64)
    x = [centre]
    for _ in range(4):
        y = np.repeat(centre, 2)
        for _ in range(3):
            y = y ^ (np.uint64(1) << rng.randint(0, 64, len(y)).astype(np.uint64))
        x.append(y)
    x.append(np.full(150, 12345, np.uint64) ^ (np.uint64(1) << rng.randint(0, 64, 150).astype(np.uint64)))
    x = np.unique(np.concatenate(x))
    group = {int(v): int(v) for v in x}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= 3):
            a, b = root(int(x[i])), root(int(x[j]))
            group[max(a, b)] = min(a, b)
    prints = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(prints, cell=cell)).collect()}
    expected = defaultdict(set)
    for v in group:
        expected[root(v)].add(v)
    got = defaultdict(set)
    for v in group:
        got[found.get(v, v - (v >> 63 << 64))].add(v)
    assert sorted(map(sorted, expected.values())) == sorted(map(sorted, got.values()))


def test_bit_sliced_counters():
    rng = np.random.RandomState(6)
    a = rng.randint(0, 1 << 62, 5000).astype(np.uint64)
    b = a.copy()
    for _ in range(6):
        b ^= np.where(rng.rand(5000) < 0.5, np.uint64(1) << rng.randint(0, 64, 5000).astype(np.uint64), np.uint64(0))
    for radius in range(4):
        assert simhash.near_pairs(a, b, radius).tolist() == np.flatnonzero(np.bitwise_count(a ^ b) <= radius).tolist()


def test_personal_data(docs, empty):
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def spans(t):
        out = []
        for kind, p in pats.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                bad = (
                    (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")))
                    or (kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)))
                    or (kind == "phone" and not 9 <= len(d) <= 15)
                )
                if not bad:
                    out.append(f"{kind}:{m.start()}:{m.end()}")
        return out

    got = pii.personal_data(docs).collect()
    expected = Counter((i, hashlib.sha256(",".join(spans(t)).encode()).hexdigest()) for i, t in every())
    assert expected == Counter((r.doc_id, r.base_sha256) for r in got)
    texts = {i: t for i, t in every()}
    for r in got:
        if r.doc_id not in (0, 3):
            assert set(spans(texts[r.doc_id])) <= set(filter(None, r.spans.split(",")))
    assert pii.personal_data(empty).count() == 0


def test_crf_learns_and_leaves_numbers_alone():
    crf = pii.trained()
    found = lambda t: {k for k, _, _ in pii.crf_spans(t, crf, [])}
    assert found("write to anna.berg at mail dot example dot org today") == {"email"}
    assert found("call (555) 123-4567 now") == {"phone"}
    for t in ("version 1.2.3", "in 1998-2004 the 3 cats", "key=0a9bc81237ff22", "order 2123465659789240 came", "costs 1,234,567"):
        assert found(t) == set(), t
    # the forward sums equal a sum over all segmentations
    text, tokens = "mail a@b.org now", [(0, 4), (5, 12), (13, 16)]
    segments = pii.SemiCRF.segments(tokens, text)
    total = 0.0

    def walk(i, score):
        nonlocal total
        if i == 3:
            total += np.exp(score)
            return
        walk(i + 1, score)
        for a, b, k, f in segments:
            if a == i:
                walk(b, score + f @ crf.w[k])

    walk(0, 0.0)
    gold = {(1, 2, "email")}
    right = sum(f @ crf.w[k] for a, b, k, f in segments if (a, b, k) in gold)
    assert crf.gradient(3, segments, gold)[0] == pytest.approx(right - np.log(total))


def test_crf_windows_cut_no_token():
    crf = pii.trained()
    redacted = lambda t: pii.redacted(t, pii.crf_spans(t, crf, []))
    for pad in range(20):
        text = "x" * pad + " call " + "(212) 555-0198, " * 300
        left = redacted(text)
        assert left.count("<phone>") == 300 and not any(c.isdigit() for c in left), left
    # tokens of any length, glued to a name or to another script
    glued = "[" + "|".join(["(212)555-0198"] * 40) + "]"
    for text in (glued, "call " + ",".join(["(212)555-0198"] * 40), "Tel:(212)555-0198", "电话：+1(212)555-0198，谢谢", "call 电话(212)555-0198谢谢"):
        assert not any(c.isdigit() for c in redacted(text)), (text, redacted(text))
    assert "谢谢" in redacted("电话：+1(212)555-0198，谢谢")
    for text in ("a" * 200_000, "a1" * 100_000, "1," * 100_000, "(" * 100_000 + "5551234567", "x@" * 50_000):
        pii.crf_spans(text, crf, [])


def test_quality_knn_held_out(spark, empty):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    made, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(rng.choice(vocab) for _ in range(80)) if good else " ".join(rng.choice(vocab[:5]).upper() + "!!" for _ in range(80))
        made.append((i, text))
        labels.append((i, int(good), 0))
    made += [(500, None), (501, ""), (None, "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (9999, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in quality_knn.quality_scores(docs, marks).withColumn("held", quality_knn.fold() == 0).collect()}
    assert len(scored) == 243 and scored[500].score == scored[501].score == 0
    held = [i for i, r in scored.items() if r.held and i is not None and i < 240]
    assert len(held) > 20 and all((scored[i].score >= 0.3) == (i % 3 > 0) for i in held)
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert quality_knn.quality_scores(docs, marks.limit(0)).where("score > 0").count() == 0
    assert quality_knn.quality_scores(empty, marks).count() == 0


def test_langid_held_out(spark, empty):
    rng = random.Random(11)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "en", "ung", "ei"], "cc": ["ção", "que", "os", "ra"]}
    made = []
    for i in range(150):
        lang = ("aa", "bb", "cc")[i % 3]
        made.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(60)), lang))
    made += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (None, "kalo", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    filters = langid.learn(docs.where(quality_knn.fold(of=3) != 1))
    got = {r.doc_id: r for r in langid.identify(docs, filters).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(got[i].lang_pred == ("aa", "bb", "cc")[i % 3] and 0 <= got[i].score <= 1 for i in range(150))
    none = langid.learn(empty.limit(0))
    assert langid.identify(docs, none).where("lang_pred <> 'und'").count() == 0
    # hits per language are those of the sets that the filters hold, up to false positives
    hits, n = filters.hits(made[0][1].encode())
    assert hits[0] >= 0.9 * n and hits[1] < 0.5 * n


def test_token_counts(docs, empty):
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(docs, path, limit=100)
    expected = Counter((i, len(t.encode()), n := len(sp.encode(t)), n > 100) for i, t in every())
    assert expected == multiset(got, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert token_counts.token_counts(empty, path).count() == 0
    assert token_counts.load(path)[2]


def test_token_counts_cut_any_text():
    path = public_tokenizers.path(token_counts.MODEL)
    sp, alone, _ = token_counts.load(path)
    rng = random.Random(4)
    chars = [*"ab ,.\n\n   \t1é½'　\r\x00▁s<>/", "<s>", "</s>", "<unk>", "<0x0A>", "  ", "\n ", "ing", "the"]
    for _ in range(5000):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(0, 20)))
        assert sum(token_counts.pieces(sp, alone, token_counts.cut(t))) == len(sp.encode(t)), t


@pytest.mark.parametrize("often", [1, 50, 1 << 20])
def test_token_counts_join(spark, docs, often):
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    long_word = "pneumono" * 400
    made = [(1, f"{long_word} {long_word} a"), (1, f"{long_word} {long_word} a"), (None, " ▁ \n\nb"), (None, None)]
    texts = spark.createDataFrame(made, "doc_id long, text string").union(docs.select("doc_id", "text"))
    got = token_counts.token_counts(texts, path, often=often)
    every_row = [(i, t or "") for i, t in made] + every()
    assert multiset(got, "doc_id", "n_tokens") == Counter((i, len(sp.encode(t))) for i, t in every_row)


def test_packing_encodes_as_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "CACHE", 300)  # generations change all the time
    rng = random.Random(3)
    chars = [*"ab'sd ,.\n\n  \t1é½'　\r\x00%&(-", "'ll", "<|endoftext|>", " \n", "²", "ñ", "‍", "😀", "ing."]
    for _ in range(30):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 25))) for _ in range(100)]
        for text, raw in zip(texts, packing.encode(texts, path), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packing_looks_a_word_up_once_a_group(monkeypatch):
    looked = Counter()

    class Counted(dict):
        def __contains__(self, key):
            looked[key] += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            looked[key] += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            looked[key] += 1
            return super().get(key, default)

    path = public_tokenizers.path(packing.TOKENIZER)
    t, caches = packing.load(path)[:2]
    monkeypatch.setitem(packing._LOADED, path, (t, [Counted(), {}], *packing.load(path)[2:]))
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé×÷ñ") for _ in range(rng.randint(1, 8))) + rng.choice(["", ",", "%%"]) for _ in range(50)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(300)]
    for text, raw in zip(texts, packing.encode(texts, path), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert max(looked.values()) <= 4  # each of the 50 words stands there about 240 times


def test_packing_puts_batches_together(monkeypatch):
    path = public_tokenizers.path(packing.TOKENIZER)
    t = packing.load(path)[0]
    monkeypatch.setattr(packing, "GROUP", 100)
    texts = ["", "one two, three\nfour", " odd  text", "÷, ñ, ×%", "", "x" * 300, "a b " * 9 + "c", "é.", ""] * 7
    rows = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    batches = [rows.slice(0, 0), *(rows.slice(k, 4) for k in range(0, len(texts), 4))]
    got = pa.Table.from_batches(packing.cutter(path, 8, 2)(iter(batches))).to_pylist()
    expected = []
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        s, e, k = 0, len(ids) % 8 or min(8, len(ids)), 0
        while s < len(ids):
            crc = zlib.crc32(ids[s:e].tobytes())
            expected.append({"doc_id": i, "piece": k, "start": s, "length": e - s, "ids_crc32": crc})
            s, e, k = e, e + 8, k + 1
    assert got == expected
    assert packing.load(path)[1] == [{}, {}]  # nothing stays in the worker


@pytest.mark.parametrize("share", [1, exact_substrings.OFTEN])
def test_exact_substrings_takes_a_context_once(spark, share):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    variants = [passage + f" variant {k}" * 3 for k in range(3)]
    made = [(k % 70, variants[0]) for k in range(300)] + [(1000, variants[1]), (None, variants[2]), (None, variants[2])]
    texts = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    rows = texts.select("doc_id", F.xxhash64("text").alias("rid"), F.col("text").cast("binary").alias("raw"))
    runs = [exact_substrings.runs_of([v.encode()]) for v in variants]
    some = [
        (int(a.view(np.int64)[j]), int(c.view(np.int64)[j]), v, int(s[j]), int(e[j]), int(p[j]))
        for v, (_, a, c, s, e, p) in zip(variants, runs, strict=True)
        for j in range(len(a))
    ]
    firsts = {(a, c): (v, s, e, p) for a, c, v, s, e, p in some}
    rid = {r.text: r.rid for r in texts.select("text", F.xxhash64("text").alias("rid")).distinct().collect()}
    ids = {variants[0]: 0, variants[1]: 1000, variants[2]: None}
    counts = spark.createDataFrame(
        [(a, c, 2, (rid[v], s, e, p, ids[v])) for (a, c), (v, s, e, p) in firsts.items()],
        "a long, c long, n long, least struct<rid: long, s: int, e: int, p: int, doc_id: long>",
    )
    often = rows.groupBy("rid").count().where(f"count > 1 and count * {share} > 303").select("rid")
    got = exact_substrings.contexts_to_compare(rows, counts, often, exact_substrings.WIDTH)
    assert Counter((r.a, r.c) for r in got.select("a", "c").collect()) == Counter(firsts.keys())
    whole = exact_substrings.exact_substring_dedup(texts, share=share)
    count = Counter(v.encode()[j : j + 400] for _, v in made for j in range(len(v) - 399))
    for r in whole.collect():
        v = next(v for v in variants if len(v) == r.n_bytes and (r.doc_id, v) in made)
        cover = bytearray(len(v))
        for j in range(len(v) - 399):
            if count[v.encode()[j : j + 400]] > 1:
                cover[j : j + 400] = b"\1" * 400
        assert r.n_removed == sum(cover)


@pytest.mark.parametrize(("words", "gram", "share"), [(5, 2, exact_substrings.OFTEN), (51, 16, exact_substrings.OFTEN), (51, 16, 1)])
def test_shared_passages_against_brute_force(docs, words, gram, share):
    owners = defaultdict(set)
    for k, (_, t) in enumerate(every()):
        w = t.encode().split()
        for j in range(len(w) - words + 1):
            owners[tuple(w[j : j + words])].add(k)
    hit = {k for x in owners.values() if len(x) > 1 for k in x}
    expected = Counter((i, t) for k, (i, t) in enumerate(every()) if k in hit)
    rows = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")
    )
    got = exact_substrings.shared_passages(rows, words, gram, share)
    texts = {r.rid: bytes(r.raw).decode() for r in rows.select("rid", "raw").collect()}
    assert Counter((r.doc_id, texts[r.rid]) for r in got.collect()) == expected


def test_exact_substrings_tells_passages_of_over_50_words(spark):
    rng = random.Random(51)

    def made(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)]

    short, close, own = made(51), made(50), made(60)  # under 400 bytes each
    texts = [
        " ".join(made(90) + short + made(40)),
        " ".join(made(10)) + "\n" + "\n\t".join(short) + " " + " ".join(made(300)),  # other white space
        " ".join(made(80) + close + made(30)),
        " ".join(made(20) + close + made(70)),
        " ".join(own + made(30) + own),  # twice in one document
        " ".join(short),
        " ".join(short[:50]),
        None,
    ]
    got = exact_substrings.exact_substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: (r.shares_passage, r.n_removed) for r in got.collect()} == {
        k: (int(k in (0, 1, 5)), 0) for k in range(len(texts))
    }


def test_votes_against_brute_force():
    rng = np.random.RandomState(2)
    rows = np.zeros((90, quality_knn.TERMS + quality_knn.FORMS), np.float32)
    rows[:, :40] = rng.poisson(1.0, (90, 40)) + (np.arange(90) % 3 > 0)[:, None] * (np.arange(40) < 9)
    rows[:, quality_knn.TERMS + rng.randint(0, 12, 90)] = 1
    rows[3] = rows[4]  # equal vectors
    labels = (np.arange(90) % 3 > 0).astype(int)
    space = quality_knn.Space(rows[:70], labels[:70])
    got = space.scores(np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)]), neighbours=70)
    share = [(labels[:70] == c).mean() for c in (0, 1)]
    for x, score in zip(rows, got, strict=False):
        z = space.weighted(x[None])[0].astype(float) @ space.basis
        z /= np.linalg.norm(z)
        w = [max(0.0, float(z @ k)) ** quality_knn.POWER / share[y] for k, y in zip(space.known, labels[:70], strict=True)]
        assert score == pytest.approx(sum(v for v, y in zip(w, labels, strict=False) if y) / sum(w), abs=1e-3)
    assert got[-1] == 0
    # with few neighbours only the nearest vote
    one = space.scores(rows[:70], neighbours=1)
    assert ((one > 0.5) == (labels[:70] == 1)).mean() > 0.97


def test_quality_knn_repeated_and_clashing(spark):
    made = [(i, ("good words in line " * 9 if i % 2 else "BAD!! " * 40) + str(i), "clash", 5) for i in range(60)]
    made += [(7, "another text of that id", "x", 1), (7, "another text of that id", "x", 1), (None, "n", "x", 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, quality string, score int")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (
        multiset(quality_knn.quality_scores(docs.repartition(n), marks).withColumn("s", F.round("score", 4)), "doc_id", "s")
        for n in (1, 5)
    )
    assert a == b and a.total() == 63


def brute_grams(raw):
    text = b" " + b" ".join(bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()) + b" "
    return [text[j : j + n] for n in langid.SIZES for j in range(len(text) - n + 1)]


@pytest.mark.parametrize("piece", [1 << 20, 7, 1])
def test_langid_hits_against_brute_force(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(12)
    say = lambda seed, n: " ".join("".join(random.Random(f"{seed}{rng.randint(0, 30)}").choice("abcdefghé") for _ in range(5)) for _ in range(n))
    learned = {f"l{i:02}": say(i, 20).encode() for i in range(70)}  # two words of languages
    hashed = {k: np.concatenate(list(langid.grams(v))) for k, v in learned.items()}
    filters = langid.Filters(hashed)
    assert filters.words == 2
    sets = {k: set(brute_grams(v)) for k, v in learned.items()}
    for raw in [*list(learned.values())[::9], b"", b" ", b"A", b"q  Q\n\tzz", say(3, 40).encode()]:
        mine = brute_grams(raw)
        hits, n = filters.hits(raw)
        assert n == len(mine) == sum(map(len, langid.grams(raw)))
        for name, got, false in zip(filters.names, hits, filters.false, strict=True):
            true = sum(g in sets[name] for g in mine)
            assert true <= got <= true + 3 + 20 * n * false
    for name, raw in list(learned.items())[::7]:
        assert filters.predict(raw.decode())[0] == name
    assert [filters.predict(t)[0] for t in ("½ ² ①", "12_", None, "")] == ["und"] * 4


def test_langid_learns_every_language(spark):
    made = [(i, f"{chr(0x4E00 + 40 * (i % 80))}{chr(0x4E01 + 40 * (i % 80))}" * 6, f"t{i % 80}", "clash", 1.0) for i in range(240)]
    made += [(5, "other text of an id", "t5", "c", 0.0), (5, "other text of an id", "t5", "c", 0.0), (None, "x", None, None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, lang_pred string, score double")
    filters = langid.learn(docs, texts=100)
    assert filters.names == sorted({f"t{i}" for i in range(80)}) and filters.words == 2
    got = langid.identify(docs, filters).collect()
    assert len(got) == 243
    assert all(r.lang_pred == f"t{r.doc_id % 80}" for r in got if r.doc_id is not None and r.doc_id != 5)
    # equal evidence: the first by name
    twins = langid.Filters({"b": np.concatenate(list(langid.grams(b"same"))), "a": np.concatenate(list(langid.grams(b"same")))})
    assert twins.predict("same") == ("a", 0.5)
