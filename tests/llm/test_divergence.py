"""The divergence audit against a dense computation in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from matchops.llm import divergence
from matchops.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, n long, page int, term string, copies int"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, most_terms):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        having = Counter(t for _, _, ws in own for t in set(ws))
        kept = sorted(t for t, n in having.items() if n >= min_docs)
        counts, all_counts = defaultdict(Counter), Counter()
        for _, source, ws in own:
            counts[source].update(w for w in ws if having[w] >= min_docs)
            all_counts.update(w for w in ws if having[w] >= min_docs)

        def share(c, kept=kept):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(all_counts)
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, most_terms)):
                for rank, (value, item) in enumerate(sorted(items)[:most], 1):
                    out.add((lang, s, part, item.decode(), -value, rank))
    return out


def result(rows):
    return [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows.collect()]


def frame(spark, rows):
    importable(spark)
    return spark.createDataFrame([(i, *r, 1, 2, "x", 3) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def test_equals_a_dense_computation(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "BETA", "été", "Ünit", "日本", "gamma", "x9y", "d'or", "tail"] + [f"w{c}" for c in "abcdefghijk"]
    rows = [(" ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice("abcde"))
            for _ in range(120)]
    copied = "alpha beta copied copied text"
    rows += [(copied, "en", rng.choice(["a", "b", None])) for _ in range(60)]
    rows += [(None, "en", "empty"), ("", "fr", "lone"), ("123 _ ~", "fr", "two"), ("beta " * 400_000 + "tail", "en", "long"),
             ("a\x00b\x80c\nA", "en", "odd"), ("once only here", "it", "p"), ("", None, None)]
    rows += rows[:5]
    found = result(divergence.audit(frame(spark, rows), min_docs=4, most_terms=6))
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, 4, 6)


def test_a_text_in_more_sources_than_a_list_holds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COPIES_PAGE", 4)
    rows = [("same words in all of them", "en", f"s{i}") for i in range(23)] + [("other words", "en", f"s{i}") for i in range(0, 23, 3)]
    assert divergence.collapsed(frame(spark, rows)).count() == 6 + 2
    assert set(result(divergence.audit(frame(spark, rows), min_docs=2))) == brute(rows, 2, 50)


def test_shares_beyond_64_bits_are_exact(spark):
    n, total, v = 3 * 10**12, 7 * 10**15, 10**9
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence._share("n", "total").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * v)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("one text", "en", "s")]])
def test_no_pairs_without_two_sources(spark, rows):
    assert result(divergence.audit(frame(spark, rows), min_docs=2)) == []


def test_pieces_end_at_separators():
    text = b"ab cd" * 600_000
    assert [w for ws in divergence.terms(text) for w in ws] == text.split()
    assert sum(1 for _ in divergence.terms(text)) > 1
