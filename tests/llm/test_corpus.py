"""Each operator against brute force on small tables, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import decontamination, hash_tree, language_model, licenses, mixing, near_copies, pipeline, quality, quality_rules, registry, simhash, substrings, warc
from wayfold.llm.common import word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=60, seed=3):
    """Texts with shared passages, near copies and exact copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = say(60), []
    for i in range(n):
        text = say(rng.randint(1, 150))
        if i % 5 == 0:
            text += "\n" + passage + " " + say(5)
        if i % 7 == 1 and out:
            text = out[-1][1]
        if i % 7 == 2 and out:
            words = out[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        out.append((i, text, "en", f"s{i % 4}", len(text)))
    return out


ODD = [
    (1, None, None, None, None), (None, "", "en", "a", 0), (None, None, None, None, None), (2, "x", "en", "b", 1), (2, "x", "en", "b", 1), (2, "x", "en", "b", 1),
    (3, "one two\x0bthree four \x85 five", "fr", None, 5), (4, " \n\t ", "en", "a", 4), (5, "word " * 40000, "en", "c", 9), (6, "😀 ñ " * 50, None, "a", 3), (7, "a" * 200000, "en", "a", 1),
]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in ("score", "TEXT", "uid", "size", "kept", "shard", "fp", "key", "h", "src", "u"):
            df = df.withColumn(c, F.lit("clash")) if c != "TEXT" else df.select("*", F.lit("clash").alias("TEXT"))
    return df


def odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "x"), (2, None), (3, ""), (None, "one two three four five")], "item_id long, text string")
    return labels, benchmark


OPERATORS = {
    "op1": substrings.deduplicated, "op2": simhash.near_duplicates, "op3": licenses.scanned, "op4": mixing.mixed, "op8": hash_tree.sharded, "op9": language_model.scored, "op10": quality_rules.judged,
    "op2 stage": simhash.one_of_each, "op4 stage": mixing.mix_rows,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(spark, name):
    n = OPERATORS[name](frame(spark, ODD)).count()
    assert n == len(ODD) or "stage" in name
    assert OPERATORS[name](frame(spark, [])).count() == 0


def test_odd_rows_with_labels_and_items(spark):
    labels, benchmark = odd_tables(spark)
    for rows in (ODD, []):
        docs = frame(spark, rows)
        for l in (labels, labels.limit(0)):
            assert quality.kept_by_quality(docs, l).columns == docs.columns
        assert decontamination.without_leaks(docs, benchmark).count() == (len(rows) - 3 if rows else 0)
        assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    assert quality.trained(frame(spark, []), labels).score(b"x") == 0.5


def test_op1_equals_brute_force(spark):
    rows = corpus()
    count, want = collections.Counter(), {}
    for _, t, *_ in rows:
        w = split(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for i, t, *_ in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        want[i] = (len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g))
    for group in (substrings.GROUP, 2, 0):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.deduplicated(frame(spark, rows), group=group).collect()}
        assert got == want


def test_op1_repeat_inside_a_text(spark):
    words = " ".join(f"w{i}" for i in range(40))
    got = substrings.deduplicated(frame(spark, [(1, f"{words} middle {words}", "", "", 0)])).first()
    assert (got.n_words, got.n_removed, got.kept) == (81, 80, "middle")


def naive_fingerprint(text, k=3):
    w = [x.translate(LOWER) for x in split(text)]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op2_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    prints = [naive_fingerprint(t) for _, t, *_ in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 2:
                    part[i] = part[j] = min(part[i], part[j])
    want = {r[0]: (f"{p:016x}", c) for r, p, c in zip(rows, prints, part)}
    for crowd in (simhash.CROWD, 0):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
        assert got == want
    assert simhash.one_of_each(frame(spark, rows)).count() == len(set(part))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_links_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & mask).bit_count() <= 2}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 8000])
def test_links_send_no_probes_to_the_driver(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(7)
    one = rng.integers(0, 1 << 22, 4000, dtype=np.uint64) << np.uint64(42) | np.uint64(0x155554AAAAA)  # they share two segments
    values = np.unique(np.concatenate([rng.integers(0, 1 << 63, 2000, dtype=np.uint64), one])).view(np.int64)
    nodes = simhash.written(spark.createDataFrame([(v,) for v in values.tolist()], "fp long"), "fingerprints")
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "4m")  # a broadcast that is larger fails
    try:
        got = {(r.a, r.b) for r in simhash.links(nodes).collect()}
    finally:
        spark.conf.unset(limit)
    want = {(a, b) for a in values.tolist() for b in values[np.bitwise_count((values ^ a).view(np.uint64)) <= 2].tolist() if a < b}
    assert got == want and len(want) > 100


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 71)} | {(101, 100)}


@pytest.mark.parametrize("name", ["op3_license_scan", "op4_source_mix"])
def test_native_operators_equal_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df, want = registry.queries()[name](spark, SF), c.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))


def test_op3_finds_shifted_template(spark):
    text = "Permission is hereby granted free of charge to any person (really) obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    row = licenses.scanned(frame(spark, [(1, text, "", "", 0)])).first()
    assert row.labels == "mit" and row.base_labels == "" and 0.8 <= row.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Code is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Code is licensed under the GNU General Public License, version 2 or later.", "gpl,gpl-2.0"),
        ("under the GNU General Public License, version", "gpl"),
        ("x licensed under the licensed under the MIT license", "mit"),
        ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
        ("licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
        ("Licensed under the Apache License, Version 1.1", "apache"),
        ("licensed under CC BY 4.0. Much later: released under the MIT license", "cc-by,cc-by-4.0,mit"),
        (licenses.TEMPLATES[5][3], "mit"),
        (licenses.TEMPLATES[9][3], "gpl,gpl-2.0"),
        (licenses.TEMPLATES[10][3].replace("redistribute it and/or modify", "pass on"), "gpl,gpl-3.0"),
        (licenses.TEMPLATES[8][3].replace("GNU General", "GNU Lesser General"), "lgpl"),
        ("no licence here", ""),
    ],
)
def test_op3_labels_by_hand(spark, text, labels):
    assert licenses.scanned(frame(spark, [(1, text, "", "", 0)])).first().labels == labels


def test_op4_targets_equal_repeated_sharing(spark):
    rng = random.Random(9)
    for _ in range(4):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 50, 500, 5000]) * rng.randint(1, 9) for i in range(12)} | {None: 40}
        weight = {s: 1 + i % 3 for i, s in enumerate(sizes)}
        target, free, left = {}, set(sizes), float(sum(sizes.values()))
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            if not over:
                break
            for s in over:
                target[s] = 3.0 * sizes[s]
            left -= sum(target[s] for s in over)
            free -= over
        target |= share
        df = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
        got = {r.src: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(target)


def test_op4_repeated_rows_come_near_the_target(spark):
    rows = [(1, "a b c d", "en", "big", 0)] * 90 + [(i, "a b c d", "en", "small", 0) for i in range(10, 40)]
    got = collections.defaultdict(lambda: [0, 0])
    for r in mixing.mixed(frame(spark, rows)).collect():
        got[r.target][0] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken - target) <= 4 for target, (taken, _) in got.items())


def test_op5_round_trip(spark):
    rng = random.Random(2)
    html = [None, "", "short", *["<p>" + "é" * rng.randint(400, 3000) + "\r\n\r\nWARC/1.1\r\n</p>" for _ in range(12)]]
    rows = [(i, f"http://x/{i}", html[i % len(html)]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: tuple(r)[1:] for r in warc.archived(pages, segment=700, chunk=90, per_file=7).collect()}
    largest = {}
    for i, _, h in rows:
        largest[(h or "").encode()] = i
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and largest[b] != i
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", largest[b] if revisit else None)
    assert warc.archived(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, None, "x" * 2000), (1, None, "x" * 2000), (None, "u", "x" * 2000)], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archived(twice).collect()) == [("1", "response", None), ("1", "revisit", 1), ("None", "revisit", 1)]


def test_op5_missing_segment_raises(spark, tmp_path):
    parts = warc.records("urn:page:1:0", None, b"y" * 5000, "0", None, segment=1000)
    (tmp_path / "part-0").write_bytes(b"".join(p + warc.END for p in parts[:2] + parts[3:]))
    with pytest.raises(Exception, match="segments missing"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_op6_edits_up_to_the_bound_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 59))] for _ in range(60)]
    docs, want = [], set()
    for n in range(240):
        item = list(items[n % 60])
        edits = n // 60 * decontamination.budget(len(item)) // 3
        for at in rng.sample(range(len(item)), edits):
            item[at] = "edited" if rng.random() < 0.6 else ""
        filler = [rng.choice(vocabulary) for _ in range(80)]
        docs.append((n, " ".join(filler[:40] + [x for x in item if x] + filler[40:]), "", "", 0))
        want.add((n, n % 60))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), benchmark, block=600).collect()}
    assert len(got & want) >= 0.99 * len(want) and not got - want


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = registry.queries()["op7_quality"](spark, sf).join(labels, "doc_id").where("held_out")
    right = scores.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.93 and registry.queries()["op7_quality"](spark, sf).count() == docs.count()


def test_op8_key_law(spark):
    df = hash_tree.sharded(frame(spark, corpus(300))).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in df) and {r.shard for r in df} <= set(range(24))
    by = collections.defaultdict(list)
    for r in df:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {r.doc_id: r.shard for r in hash_tree.sharded(frame(spark, corpus(40))).collect()}
    assert all(again[r.doc_id] == r.shard for r in df if r.doc_id in again)
    texts = {i: t for i, t, *_ in corpus(300)}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in df)


@pytest.mark.parametrize("common", [language_model.COMMON, 50])
def test_op9_base_equals_brute_force(spark, common):
    rows = corpus()
    tokens = {i: [x.translate(LOWER) for x in split(t)] + ["\n"] for i, t, *_ in rows}
    count = collections.Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in t)
    n, v = sum(count.values()), len(count)
    for r in language_model.scored(frame(spark, rows), common).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x in count for x in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert r.score < 0


def test_op9_probabilities_sum_to_one():
    w = language_model.Weights.start([(int(h), 9) for h in word_hashes([b"a", b"b", b"c"]).view(np.int64)], 40)
    one = two = np.zeros(3, np.uint64)
    slot = np.arange(3)
    p, _, q = language_model.probabilities(w, slot, language_model.features(slot, one, two))
    assert p.sum(1) == pytest.approx(1, abs=1e-5) and q.sum(1) == pytest.approx(1, abs=1e-5)


def test_op10_counts_equal_brute_force():
    for _, t, *_ in corpus() + [r for r in ODD if r[1]][:6] + [(0, "a b c a b c\nx#y\n\n \nx#y", "", "", 0)]:
        w, seen, twice = split(t), set(), 0
        for line in t.split("\n"):
            if split(line):
                twice += line in seen
                seen.add(line)
        count = collections.Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert quality_rules.rules(t.encode()) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(again))


def test_op10_model_sums_to_one(spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate(["abab abba", "baab ab", "aabb b"] * 5)]
    lm = quality_rules.model(quality_rules.counted(frame(spark, rows)))
    symbols = [*map(ord, "ab "), quality_rules.EDGE]
    for context in ((97, 98), (98, 97), (32, 98)):
        p = [10 ** lm.log10(np.array([context[0] << 42 | context[1] << 21 | s])) for s in [*symbols, 0x4E00]]
        assert sum(p[:-1]) + ((1 << 21) - len(symbols)) * p[-1] == pytest.approx(1, abs=1e-6)


def test_op10_bands_reject_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.queries()["op10_quality_rules"](spark, sf).where("NOT base_failed").join(labels, "doc_id")
    rejected = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("share")).collect()}
    assert rejected[0] > 0.25 and rejected[1] < 0.01


def test_op10_model_as_a_table_gives_the_same(spark):
    rows = corpus()
    arrays, table = ({r.doc_id: r for r in quality_rules.judged(frame(spark, rows), n).collect()} for n in (quality_rules.ENTRIES, 0))
    for i, r in arrays.items():
        assert r.log_perplexity == pytest.approx(table[i].log_perplexity) and r.kept == table[i].kept


def test_op10_kept_equals_brute_force(spark):
    """Kept, bands and discounts again, in plain Python, from the texts."""
    rows = corpus()
    count, names = [collections.Counter() for _ in range(3)], {}
    for i, t, *_ in rows:
        x = [None, None, *" ".join(split(t)), "end"]
        names[i] = [tuple(x[j - 2 : j + 1]) for j in range(2, len(x))]
        count[2].update(names[i])
    for n in (1, 0):
        count[n].update(k[1:] for k in count[n + 1])
    d, of_context, lost = [], [], []
    for n in range(3):
        m = [sum(v == j for v in count[n].values()) for j in range(1, 5)]
        y = m[0] / (m[0] + 2 * m[1])
        d.append([min(max(j - (j + 1) * y * m[j] / m[j - 1] if m[j - 1] else 0.9, 0.05), j - 0.05) for j in (1, 2, 3)] if m[0] and m[1] else [0.5, 0.75, 0.9])
        a, b = collections.Counter(), collections.Counter()
        for k, v in count[n].items():
            a[k[:-1]] += v
            b[k[:-1]] += min(v, d[n][min(v, 3) - 1])
        of_context.append(a)
        lost.append(b)

    def p(k):
        if not k:
            return 1 / (1 << 21)
        n = len(k) - 1
        c, v = k[:-1], count[n][k]
        return (v - min(v, d[n][min(v, 3) - 1])) / of_context[n][c] + lost[n][c] / of_context[n][c] * p(k[1:])

    want = {i: -float(np.mean([np.log10(p(k)) for k in g])) for i, g in names.items()}
    got = {r.doc_id: r for r in quality_rules.judged(frame(spark, rows)).collect()}
    assert {i: r.log_perplexity for i, r in got.items()} == pytest.approx(want)
    for i, t, *_ in rows:
        r = got[i]
        assert r.base_failed == (len(split(t)) < 50 or 100 * r.n_repeat_words > 50 * len(split(t)))
        assert r.kept == (not r.base_failed and r.lower <= want[i] <= r.upper)
    assert {r.kept for r in got.values() if not r.base_failed} == {True}


def test_op10_bands_without_spread(spark):
    rows = spark.createDataFrame([("x", 1.0)] * 9 + [("y", 1.0 + i / 100) for i in range(9)], "lang string, log_perplexity double")
    got = {r.lang: r for r in quality_rules.bands(rows).collect()}
    assert got["x"].upper - got["x"].lower == pytest.approx(2 * quality_rules.LEAST)
    assert got["y"].upper - got["y"].lower == pytest.approx((quality_rules.ABOVE + quality_rules.BELOW) * 0.02, rel=0.2)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in pipeline.quality_filter(spark, docs, SF).select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert len([d for d in good if d in kept]) >= 0.97 * len(good)
    assert pipeline.run(spark, SF).count() > 0
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0
        stage(spark, frame(spark, ODD), SF).count()


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    say = lambda k: [f"w{rng.randrange(300)}" for _ in range(k)]
    passage, texts = say(40), [say(n) for n in (1, 3, 5, 6, 12, 40, 120, 300)]
    for base in [say(rng.randint(20, 200)) for _ in range(25)]:
        base += passage * (rng.random() < 0.5)
        for _ in range(4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(0, 1 + len(copy) // 40)):
                copy[at] = "edited"
            texts.append(copy[: len(copy) - rng.choice([0, 0, 3, len(copy) // 6])])
    texts += [texts[9], [x.upper() for x in texts[20]], [], []]
    rng.shuffle(texts)
    k = pipeline.SHINGLE
    sets = [{tuple(x.lower() for x in t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in texts]
    root, near = list(range(len(texts))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                near += a != b
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = frame(spark, [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)])
    got = sorted(r[0] for r in pipeline.near_dedup(spark, docs, SF).select("doc_id").collect())
    assert near > 20 and got == sorted(set(root))


def compared(monkeypatch):
    """The numbers of pairs that near_dedup compares, call by call."""
    calls, similar = [], near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, *rest: calls.append(pairs.distinct().count()) or similar(pairs, *rest))
    return calls


def test_near_dedup_joins_a_large_group_without_all_its_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(150)], []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(5, 145), i and rng.choice([1, 2, 2, 3, 3, 3])):
            copy[at] = f"edited{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    calls = compared(monkeypatch)
    got = near_copies.one_of_each(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 5)
    assert [r.doc_id for r in got.collect()] == [0]  # each is similar to the first
    assert sum(calls) < 6 * len(texts), calls


def test_near_dedup_begins_with_linked_fingerprints(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(700)]
        for at in range(4):
            texts.append(" ".join(base[: 350 + at] + ["edited"] * (at > 0) + base[351 + at :]))
    texts += ["one two three", ""]
    prints = sorted({naive_fingerprint(t, 5) for t in texts if t})
    linked = sum((p ^ q).bit_count() <= 2 for i, p in enumerate(prints) for q in prints[:i])
    calls = compared(monkeypatch)
    near_copies.one_of_each(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 5)
    assert linked > 10 and calls[0] == linked + len(texts) - 1 - len(prints)


def edit_distance_to_infix(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (w != x)))
    return min(row)


@pytest.mark.parametrize("kind", ["change", "insert", "delete"])
@pytest.mark.parametrize("length", [14, 30, 60, 150])
def test_op6_recall_at_the_bound(kind, length):
    """All edits that an item may have, of one kind, in its first half."""
    rng = random.Random(length)
    items = [[f"w{rng.randrange(5000)}" for _ in range(length)] for _ in range(40)]
    index = decontamination.Index(list(range(40)), [word_hashes([w.encode() for w in i]) for i in items])
    found = 0
    for n, item in enumerate(items):
        text = list(item)
        edits = decontamination.budget(length)
        for at in sorted(rng.sample(range(max(edits, length // 2)), edits), reverse=True):
            if kind == "insert":
                text.insert(at, "new")
            elif kind == "change":
                text[at] = "new"
            else:
                del text[at]
        text = [f"f{rng.randrange(5000)}" for _ in range(30)] + text + [f"f{rng.randrange(5000)}" for _ in range(30)]
        found += n in {m[1] for m in index.matches([word_hashes([w.encode() for w in text])])}
    assert found >= 39


def test_op6_equals_all_pairs_by_edit_distance(spark):
    rng = random.Random(8)
    say = lambda k: [f"w{rng.randrange(40)}" for _ in range(k)]
    items = [say(n) for n in (1, 2, 4, 9, 15, 25, 45, 70)] + [[]]
    docs = []
    for n in range(60):
        text = say(30)
        item = list(items[n % 8])
        for at in rng.sample(range(len(item)), min(len(item), rng.randint(0, 1 + len(item) // 4))):
            item[at] = rng.choice(["x", "y z", ""])
        docs.append(" ".join([*text[:15], *item, *text[15:]]).split())
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {(n, i): edit_distance_to_infix(x, t) for n, t in enumerate(docs) for i, x in enumerate(items) if x}
    want = {k: d for k, d in want.items() if d <= decontamination.budget(len(items[k[1]]))}
    rows = [(n, " ".join(t), "", "", 0) for n, t in enumerate(docs)]
    for block in (decontamination.BLOCK, 30):
        got = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(frame(spark, rows), benchmark, block=block).collect()}
        assert got == want
    kept = sorted(r[0] for r in decontamination.without_leaks(frame(spark, rows), benchmark, block=30).select("doc_id").collect())
    assert kept == sorted(set(range(60)) - {n for n, _ in want})


def test_op7_fit_solves_the_dual():
    """Log-count ratios counted by hand, and no change of one dual variable lowers the objective."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 12)) + 100 * int(y) * (i % 3 > 0) for i, y in enumerate(rng.integers(0, 2, 40))]
    y = np.array([int(r.max() >= 100) for r in rows])
    m = quality.fit(rows, y)
    counts = {s: np.full(1 << quality.BITS, quality.SMOOTH) for s in (0, 1)}
    for r, label in zip(rows, y, strict=True):
        counts[label][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((40, 200))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / len(r) ** 0.5
    w = np.divide(m.weights[:200], ratio[:200], out=np.zeros(200), where=ratio[:200] != 0)
    margins = np.where(y > 0, 1, -1) * (x @ w + m.bias)
    hinge = lambda w, b: 0.5 * (w @ w + b * b) + quality.C * np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w + b)).sum()
    best = hinge(w, m.bias)
    assert (margins > 0).all()
    for _ in range(50):
        step = rng.normal(size=201) * 0.05
        assert hinge(w + step[:200], m.bias + step[200]) > best - 0.02 * best


def test_op7_on_odd_rows(spark):
    labels, _ = odd_tables(spark)
    model = quality.trained(frame(spark, ODD), labels)
    score = quality.scorer(spark, model)
    got = frame(spark, ODD, clash=False).select("doc_id", score("text").alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if r.doc_id == 2}) == 1


def test_op8_weights_move_rows_only_into_or_out_of_their_subtree(spark):
    keys = spark.range(4000).select(F.col("id").alias("k"))
    tree = hash_tree.layout()
    heavier = hash_tree.Tree(tuple(tuple(tuple((s, 2.0 if s == 5 else w) for s, w in rack) for rack in region) for region in tree.regions))
    of = lambda t: {r.k: r.s for r in keys.select("k", hash_tree.shard_of(t, F.col("k")).alias("s")).collect()}
    before, after = of(tree), of(heavier)
    moved = {(before[k], after[k]) for k in before if before[k] != after[k]}
    where = {s: (i, j) for i, region in enumerate(tree.regions) for j, rack in enumerate(region) for s, _ in rack}
    # rows leave for the subtree whose weight grew, and never between other subtrees
    assert moved and all(b == 5 or where[b][0] == where[5][0] for _, b in moved)
    share = collections.Counter(before.values())
    assert all(abs(n - 4000 / 24) < 5 * (4000 / 24) ** 0.5 for n in share.values())
    assert collections.Counter(after.values())[5] > 1.4 * share[5]


def test_results_do_not_depend_on_how_files_are_split(spark, tmp_path):
    rows = corpus(120) + [(7, "same text", "en", "s1", 1)] * 5
    frame(spark, rows, clash=False).repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    docs = lambda: spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = {"op1": lambda: substrings.deduplicated(docs()), "near": lambda: near_copies.one_of_each(docs(), 5), "simhash": lambda: simhash.one_of_each(docs()), "mix": lambda: mixing.mix_rows(docs())}
    try:
        for name, make in names.items():
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", 4)
            df = make()  # part of the work is done here, the rest when it is collected
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", 3)
            got = sorted(map(str, df.collect()))
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
            if name == "mix":
                size = collections.Counter()
                for x in df.collect():
                    size[x.source] += len(split(x.text))
                plan = {r.source_size: r.target for r in mixing.mixed(docs()).collect()}
                whole = collections.Counter()
                for _, t, _, source, _ in rows:
                    whole[source] += len(split(t))
                assert all(abs(size[s] - plan[whole[s]]) <= 151 for s in whole)
            else:
                assert got == sorted(map(str, make().collect())), name
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
