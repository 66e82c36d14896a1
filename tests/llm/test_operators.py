"""Each operator against brute force on small tables with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from matchops.llm import (bpe, components, fingerprints, language, licenses, near_dups, packing, sharding, token_counts,
                          topk, toxicity)
from matchops.llm.common import importable
from matchops.llm.tokens import JsonTokenizer

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, ids int, score string, p string"
RNG = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "stone", "river", "cloud", "green", "light", "paper", "Été", "日本", "12", "don't", "x\ty", "  z"]
BASE = " ".join(RNG.choice(WORDS) + str(i % 17) for i in range(120))
TEXTS = [
    None, "", " ", "\n\t", "one", "one two three", BASE, BASE, BASE.replace("stone", "Stone"), BASE + " extra", "a" * 9000,
    "word " * 3000, " ".join(RNG.choice(WORDS) for _ in range(4000)), "<|endoftext|> in <|endoftext|>", "😀 é́ \U000323b0x", BASE.replace("river", "lake", 1),
    *(" ".join(RNG.choice(WORDS) + RNG.choice("abcdef") for _ in range(RNG.randint(1, 90))) for _ in range(40)),
]


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = [(i, t, ["en", "fr", None][i % 3], "s", -1, 1, 2, "x", "y") for i, t in enumerate(TEXTS)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    importable(spark)
    return spark.createDataFrame([], SCHEMA)


def text_of(i):
    return TEXTS[i] or ""


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = topk.quantised(vectors, "vec_id", "embedding", 1024)
    for out in (toxicity.score(empty, labels), packing.pack(empty, JSON), bpe.encode(empty, RANKS, public_tokenizers.PATTERN),
                sharding.shard_bytes(empty), language.identify(empty), token_counts.count(empty, JSON), licenses.scan(empty),
                bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN), fingerprints.fingerprint_edits(empty), topk.top_k(v, v, 3), near_dups.near_duplicates(empty)):
        assert out.count() == 0


def test_codec_matches_library_and_round_trips(docs):
    import tiktoken

    from matchops.llm.tokens import ranks_of_tiktoken
    core = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of_tiktoken(RANKS), special_tokens={})
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()))
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert list(r.ids) == core.encode_ordinary(text_of(r.doc_id))
        assert bytes(r.bytes) == text_of(r.doc_id).encode()


def test_codec_on_random_strings():
    import tiktoken

    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    core = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t\x1c'stAbé1٣!日͸😀") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(3000)), "ab" * 5000, "=" * 4000]
    assert [x.tolist() for x in codec.encode(texts)] == [core.encode_ordinary(t) for t in texts]


def test_json_ids_match_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(JSON), JsonTokenizer(JSON)
    rng = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(" \n\t'stAbé1!日😀") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    packed = packing.pack(docs, JSON, with_ids=True)
    rows = packed.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]})
        assert sum(p[1] for p in pieces) == len(ids) == pieces[0][3]
        for start, length, crc, _ in pieces:
            assert zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == crc
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        assert sum(r.length for r in parts) <= 2048
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit([7, 6, 3, 2, 1], 10) == [(0, 0), (1, 0), (0, 7), (1, 6), (1, 8)]
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 2048) for _ in range(800)), reverse=True)
    left, expected = [], []
    for n in lengths:
        fits = [w for w, c in enumerate(left) if c >= n]
        w = min(fits, key=lambda w: left[w], default=None)
        if w is None:
            left.append(2048)
            w = len(left) - 1
        expected.append(2048 - left[w])
        left[w] -= n
    got = packing.best_fit(lengths)
    assert sorted(o for _, o in got) == sorted(expected) and len({w for w, _ in got}) == len(left)


def test_shards_are_gapless_and_even(docs):
    rows = sharding.shard_bytes(docs, shards=4).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        data = text_of(r.doc_id).encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(4):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= largest


def test_shards_divide_a_text_that_most_rows_share(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = sharding.shard_bytes(rows, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(sizes) == 8 and max(r.b for r in sizes) - min(r.b for r in sizes) <= 40


def test_token_counts_match_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = token_counts.count(docs, JSON).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = text_of(r.doc_id)
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))


def test_token_counts_of_pre_tokens_beside_entries_that_are_no_text(spark):
    from tokenizers import Tokenizer

    importable(spark)
    library = Tokenizer.from_file(JSON)
    # each is the rest of an entry that is not UTF-8, and no entry itself
    texts = ["\u9192", "\u6975", "\u9192 \u6975", "a \u9192", *(bytes(w).decode(errors="ignore") for w in token_counts.ranks_of_json(JSON)[0])]
    rows = token_counts.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).collect()
    assert library.encode("\u9192", add_special_tokens=False).ids != library.encode("\u6975", add_special_tokens=False).ids
    found = {r.doc_id: r.n_tokens for r in rows}
    assert [found[i] for i in range(len(texts))] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [found[0], found[1]] == [2, 2]


def test_licenses_find_exact_and_edited_notices(spark):
    importable(spark)
    notice = licenses.TEMPLATES["GPL-3.0"]
    rows = [(1, f"some words\n{notice}\nmore"), (2, notice.replace("licensed", "kindly licensed").upper()), (3, "the public license of a work"),
            (4, None), (5, ""), (6, notice + " filler " * 50 + notice)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "GPL-3.0"), (2, "GPL-3.0"), (6, "GPL-3.0"), (6, "GPL-3.0")]
    one = next(r for r in got if r.doc_id == 1)
    assert one.coverage == 1.0 and rows[0][1][one.span_start:one.span_end] == notice.rstrip(".")


def test_fingerprints_of_edits(docs):
    rows = fingerprints.fingerprint_edits(docs.dropDuplicates(["doc_id"])).collect()
    assert len(rows) == len(TEXTS)
    prints = {}
    for r in rows:
        t, after = text_of(r.doc_id), text_of((r.doc_id + 1) % len(TEXTS))
        half = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and (t != after or r.near_next == 1)
    long = [r for r in rows if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])


def test_fingerprint_likeness_follows_edits_and_bands_find_pairs(spark):
    importable(spark)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(3000))
    small = text[:1500] + "Z" + text[1501:2000] + "yy" + text[2000:]
    other = "".join(rng.choice("abcdefghij klmno") for _ in range(3000))
    a, b, c = fingerprints.prints([text, small, other])
    assert a.likeness(b) > 0.8 > 0.3 > a.likeness(c) and a.likeness(a) == 1
    assert str(fingerprints.parse(str(a))) == str(a)
    rows = fingerprints.fingerprint_edits(spark.createDataFrame([(1, text), (2, small), (3, other), (4, text)], "doc_id long, text string"))
    assert {(r.a, r.b) for r in fingerprints.near_pairs(rows, 0.6).collect()} == {(1, 2)}


def test_near_pairs_compare_all_members_of_a_band(spark):
    from matchops.llm.queries import QUERIES

    importable(spark)
    rng = random.Random(21)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(900))
    other = "".join(rng.choice("abcdefghij klmno") for _ in range(900))
    found = fingerprints.prints([other, *(text + "z" * i for i in range(3))])
    rows = [(i, str(p), [7, 8]) for i, p in enumerate(found)]  # the least id of each band is unlike the rest
    got = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string, bands array<long>")).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (1, 3), (2, 3)]
    assert "op8_near_pairs" in QUERIES


def test_top_k_matches_brute_force(spark):
    importable(spark)
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(0, 0.3, (600, 9)), 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)] + [(7, [0.5] * 9), (800, None), (801, [0.1, None]), (802, [float("nan")] * 9), (None, [1.0] * 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v = topk.quantised(table, "vec_id", "embedding", 1024)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 10).collect()}
    whole = [(i, np.floor(1024 * np.array(x))) for i, x in rows[:601]]
    for q, x in whole:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q)[:10]
            assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]


def jaccard_components(texts, words, threshold):
    import re
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t)) if x]
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(docs):
    for words in (4, 5):
        expected = jaccard_components([t or "" for t in TEXTS], words, 0.8)
        rows = near_dups.near_duplicates(docs, words=words).collect()
        assert len(rows) == len(TEXTS) + 1
        for r in rows:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def template_group(rng, n, fill):
    """Texts of one template, most pairs at a similarity below 0.8, and every fifth text followed by a nearer one."""
    base, texts = [f"w{i}" for i in range(140)], []
    while len(texts) < n:
        w = base + [f"{fill(rng)}x{i}" for i in range(21)]
        texts.append(" ".join(w))
        if len(texts) % 5 == 0:
            texts.append(" ".join(w[:-15] + [f"{fill(rng)}y{i}" for i in range(15)]))
    return texts


@pytest.mark.parametrize("fill", [lambda rng: rng.randint(0, 10**9), lambda rng: rng.randint(0, 9)])
def test_near_duplicates_below_the_threshold_of_their_template(spark, fill):
    importable(spark)
    texts = template_group(random.Random(12), 600, fill)
    expected = jaccard_components(texts, 4, 0.8)
    if fill(random.Random(1)) > 9:
        assert 100 < len({c for _, c in expected}) < len(texts) - 100
    rows = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(expected))


def test_near_duplicate_regions_go_on_over_range_boundaries(spark):
    importable(spark)
    rng = random.Random(13)
    texts = []
    for g in range(40):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(80)]
        texts += [" ".join([*base, f"t{i}", f"u{i}"]) for i in range(8)]
    found = near_dups.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4)
    classes = found.withColumnRenamed("doc_id", "rep")
    width, pairs = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for n in (1, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            pairs[n] = {tuple(r) for r in near_dups.candidates(classes, 0.8)[0].collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert pairs[1] <= pairs[60]


def test_near_duplicates_in_a_crowded_group(spark):
    importable(spark)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(200)] = f"v{rng.randint(0, 99)}"
        texts.append(" ".join(w))
    rows = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4).collect()
    expected = jaccard_components(texts, 4, 0.8)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}


def test_language_on_held_out_rows(spark):
    importable(spark)
    rng = random.Random(6)
    parts = {"en": ["the", "and", "of", "ing", "tion"], "de": ["der", "und", "ein", "sch", "keit"], "fr": ["le", "et", "que", "eau", "ment"]}
    rows = [(i, " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) for _ in range(rng.randint(3, 40))), k) for i in range(600) for k in [rng.choice(sorted(parts))]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 !?", "fr"), (1003, "the tion and", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, k) for i, _, k in rows[:600] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].lang_pred == k for i, k in held]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_licenses_back_to_back_and_with_lost_words(spark):
    importable(spark)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, notice in licenses.TEMPLATES.items():
        for copies in (2, 3, 5):
            text = " ".join([notice] * copies)
            assert [(f[0], f[2], text[f[3]:f[4]] in notice) for f in scanner.scan(text) if f[0] == name] == [(name, 1.0, True)] * copies
        words = licenses._WORD.findall(notice)
        lost = len(words) // 5
        step = -(-len(words) // (lost + 1))
        cut = ["other" if i % step == step - 1 and i // step < lost else w for i, w in enumerate(words)]
        assert name in {f[0] for f in scanner.scan(" ".join(cut))}
    rows = [(1, "Released under an MIT License."), (2, "Released under the MIT License. " * 2)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.matched_words) for r in got) == [(1, "MIT", 4), (2, "MIT", 5), (2, "MIT", 5)]
    short = licenses.Scanner({"one": "Unlicense", "two": "Public domain"})
    assert [f[0] for f in short.scan("the unlicense, or public domain")] == ["one", "two"]


def test_toxicity_on_held_out_rows(spark):
    importable(spark)
    rng = random.Random(8)
    bad = ["grumblo", "snarfish", "blortful", "wexling"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(10, 80))]
        toxic = rng.random() < 0.15
        for word in rng.sample(bad, 2) if toxic else []:
            w.insert(rng.randrange(len(w)), word)
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, "")]
    labels += [(2000, None), (None, 1)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    got = {r.doc_id: r for r in out}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {i: any(b in t for b in bad) for i, t in rows[:900]}
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in range(900)]) > 0.97
    assert not any(got[i].predicted for i in (2000, 2001)) and len(out) == len(rows)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(60)) + (" grumblo snarfish" if i % 9 == 0 else ""), "en", "s", 1) for i in range(300)]
    rows += [(300, rows[1][1], "en", "s", 1), (301, "123 !!", "en", "s", 1), (302, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows if "grumblo" not in (r[1] or "")}
    done = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert done == {r[0] for r in rows[:300] if "grumblo" not in r[1]}


def test_toxicity_shuffles_the_labelled_texts_only(spark, monkeypatch):
    """At any size of the label table, and with any size of the bitmap, the same rows."""
    rows = [(i if i % 50 else None, f"text {i}") for i in range(2000)] + [(7, "text 7 again"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(0, 2000, 8)] + [(7, 0), (7, 1), (5000, 1), (None, 1), (8, 1)], "doc_id long, toxic int")
    want = sorted(map(tuple, docs.selectExpr("doc_id", "coalesce(text, '') AS text").join(labelled, "doc_id").select("text", "toxic").collect()))
    assert ("text 7", 1) in want and ("text 7 again", 0) in want and ("", 1) in want
    for bits in (1 << 25, 64):
        monkeypatch.setattr(toxicity, "BITS", bits)
        got = toxicity.labelled_texts(docs, labelled)
        assert sorted(map(tuple, got.collect())) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        above = plan[plan.index("SortMergeJoin"):]  # what is shuffled for the join has met the bitmap
        assert "bit" in above and above.index("BroadcastHashJoin") > above.index("Exchange hashpartitioning")


def test_pattern_voters_read_whole_texts():
    def fires(text):
        return toxicity.marks_of(text, toxicity.Marker({}))

    calm = "plain words here " * 3000
    assert fires(calm) == []
    assert 1 in fires(calm + "no!!! way!!! " * 9000)
    assert 3 in fires(calm + "$#%& " * 9000)
    assert 3 in fires("$#%&") and 2 in fires("sooooo")


def test_toxicity_voters_of_a_small_language_vote(spark):
    """One row in ten is of a second language, with toxic words of its own."""
    importable(spark)
    rng = random.Random(9)
    bad = {"en": ["grumblo", "snarfish", "blortful", "wexling"], "xx": ["zzorpan", "qquilto"]}
    other = [f"{a}{b}" for a in ("ael", "oru", "imi", "une") for b in ("ta", "ko", "shi", "va", "ro")]
    rows, labels, truth = [], [], {}
    for i in range(3000):
        lang = "xx" if i % 10 == 3 else "en"
        w = [rng.choice(other if lang == "xx" else WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(20, 80))]
        truth[i] = lang, rng.random() < 0.15
        for word in bad[lang] if truth[i][1] else []:
            w.insert(rng.randrange(len(w)), word)
        rows.append((i, " ".join(w)))
        labels.append((i, int(truth[i][1])))
    rows += [(i, "always the same hateful copy") for i in range(5000, 5400)]  # a group of copies teaches once
    labels += [(i, 1) for i in range(5000, 5400)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"),
                                               spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for lang in bad:
        held = [i for i, (of, toxic) in truth.items() if of == lang and toxic and got[i].held_out]
        assert np.mean([got[i].predicted for i in held]) > 0.9
    clean = [i for i, (_, toxic) in truth.items() if not toxic]
    assert not any(got[i].predicted for i in clean)


def test_pipeline_keeps_one_row_of_each_group_whatever_its_ids(spark):
    import corpus_pipeline

    rng = random.Random(31)
    a, b, c, d = (" ".join(rng.choice(WORDS[:10]) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (5, a), (3, a + " more"), (None, b), (None, b), (7, c), (7, c), (7, d), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(got, key=str) == sorted([(3, a + " more"), (None, b), (7, c), (7, d), (8, ""), (None, None)], key=str)
