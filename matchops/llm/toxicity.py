"""Toxicity scores by weak supervision.

1. Lexicon voters are words and word beginnings, each also at a density of
   the text's words.  They are counted over all labelled rows that are not
   held out (each text once), by partial counts in tasks and one groupBy.  A
   stem votes if toxic rows carry it ``LIKELIHOOD`` times as often as clean
   ones and if that is significant among all stems tried; of stems that
   begin alike the one with most evidence votes.  No number limits them, so a
   language with few toxic rows gets its own voters.  A few pattern voters
   look at the form of a text.
2. One pass marks every document with its voters and the further signs that
   the classifier may use.  A generative model with a hidden toxic/clean
   class is fitted by EM over the votes of all documents (equal votes are
   counted once): it estimates how often each voter fires in either class,
   and which voters depend on each other given the class.  Dependent voters
   share their say.  A voter that is silent abstains: voters of one language
   say nothing about a text in another.  What silence tells on the whole is
   in the intercept: the expected share of toxic documents is that of the
   labelled rows.
3. A sparse linear classifier (proximal AdaGrad, L1) learns the posterior
   labels of a bounded sample of documents and scores every whole text.

Contract: null and empty texts are scored like a text without words; rows
without label, or with a null one, teach the lexicon nothing; without any
toxic label there are no lexicon voters, the pattern voters that fire are
untaught, and no score reaches 0.5.
A line that a text repeats counts once.  Repeated rows are scored alike; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.llm.common import held_out, map_texts, slices, texts
from matchops.session import materialize

POSTERIOR = 3000  # documents of each posterior class that the classifier learns from, at most
FEATURES = 20_000  # signs besides the voters that the classifier may use, those with most evidence
ROUNDS = 6
TIE_ROUNDS = (0, 3)  # in which dependences are estimated
LIKELIHOOD = 30  # a stem votes if toxic rows carry it this many times as often as clean ones
SIGN = 8  # the same for a sign
MARGIN = 3.0  # log evidence beyond that for one false stem among all
EPOCHS = 10
ANCHOR = 4.0  # weight of the labelled rows against all documents in the label model
RATE, L1 = 0.3, 0.005
LEVELS = ("", "!", "!!")  # a stem occurs; is at least these shares of a text's words, and occurs more than once
DENSE = (0.0, 0.005, 0.01)
BITS = 1 << 25  # of the bitmap of labelled ids
STEMS = 400_000  # of a task; beyond it partial counts go out early
_WORD = re.compile(r"\w+")
_STRETCHED, _MASKED = re.compile(r"(\w)\1{3,}"), re.compile(r"[#$%&*]{3,}")
PATTERNS = 4


def stems(word: str) -> list[str]:
    """The word and its beginnings, the latter marked."""
    return [word, *(word[:n] + "-" for n in range(4, 9) if len(word) >= n)]


def split(text: str) -> list[str]:
    """Lower-case words; a repeated line counts once."""
    lines = text.lower().split("\n")
    return _WORD.findall("\n".join(dict.fromkeys(lines)))


def forms(text: str, words: dict[str, int], n: int) -> list[int]:
    """Numbers of the pattern voters that fire."""
    plain = text.split()
    stretched = sum(k for w, k in words.items() if len(w) > 3 and _STRETCHED.search(w))
    fires = (sum(map(str.isupper, plain)) > 0.3 * len(plain) > 3, text.count("!") > 0.1 * len(plain) > 1,
             stretched > 0.005 * n, len(_MASKED.findall(text)) > 0.005 * len(plain))
    return [j for j, x in enumerate(fires) if x]


class Marker:
    """Numbers of the marks that a text carries; ``number`` names the marks
    of interest, stems with the suffix of a level."""

    def __init__(self, number: dict[str, int]):
        self.number, self.memo = number, {}

    def _of(self, word: str) -> tuple:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            levels = (tuple(self.number.get(s + x, -1) for x in LEVELS) for s in stems(word))
            found = self.memo[word] = tuple(v for v in levels if max(v) >= 0)
        return found

    def __call__(self, words: dict[str, int], n: int) -> list[int]:
        counts: dict[tuple, int] = {}
        of = self._of
        for word, k in words.items():
            for v in of(word):
                counts[v] = counts.get(v, 0) + k
        return [i for v, k in counts.items() for i, share in zip(v, DENSE, strict=True) if i >= 0 and k >= share * n and (k > 1 or not share)]


class Tally:
    """Rows of either class that carry each stem, at each level."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.memo: dict[str, np.ndarray] = {}
        self.rows = np.zeros((2, len(LEVELS), 1 << 12), np.int64)

    def _of(self, word: str) -> np.ndarray:
        found = self.memo.get(word)
        if found is None:
            found = self.memo[word] = np.array([self.number.setdefault(s, len(self.number)) for s in stems(word)])
        return found

    def add(self, words: dict[str, int], n: int, toxic: int) -> None:
        if not words:
            return
        parts = [self._of(w) for w in words]
        while len(self.number) > self.rows.shape[2]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=2)
        times = np.repeat(list(words.values()), [len(p) for p in parts])
        at, where = np.unique(np.concatenate(parts), return_inverse=True)
        k = np.bincount(where, weights=times)
        for level, share in enumerate(DENSE):
            self.rows[toxic, level, at if not level else at[(k >= share * n) & (k > 1)]] += 1

    def batches(self, schema: pa.Schema):
        names = np.array(list(self.number), object)
        for level, suffix in enumerate(LEVELS):
            neg, pos = self.rows[:, level, :len(names)]
            at = np.flatnonzero(neg + pos)
            for lo in range(0, len(at), 1 << 16):
                some = at[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([s + suffix for s in names[some]], pa.string()), pa.array(pos[some]), pa.array(neg[some])],
                                                 schema=schema)


class Lexicon:
    """Marks by number: pattern voters, lexicon voters, then further signs;
    how many labelled rows of either class carry each voter; class sizes."""

    def __init__(self, voters: list[tuple[str, int, int]], signs: list[str], shown: np.ndarray, rows: np.ndarray):
        self.voters = PATTERNS + len(voters)
        self.number = {s: PATTERNS + i for i, s in enumerate([*(v[0] for v in voters), *signs])}
        self.fired = np.concatenate([shown, np.array([[neg for _, _, neg in voters], [pos for _, pos, _ in voters]], float).reshape(2, -1)], axis=1)
        self.rows = rows


def labelled_texts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(text, toxic) of the rows of ``labelled(doc_id, toxic)``.

    A bitmap of fixed size (at most ``BITS`` / 64 rows) holds their hashed ids,
    and only texts that it lets through are shuffled; the join leaves out those
    it should not have let through.  It is a merge join for few rows too: the
    plan is the same at any size."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word, bit = F.shiftright(slot, 6), F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    bitmap = labelled.select(word.alias("_word"), slot.alias("_slot")).groupBy("_word").agg(F.bit_or(bit).alias("_bits"))
    near = texts(docs).withColumns({"_word": word, "_slot": slot}).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return near.select("doc_id", "text").join(labelled.hint("merge"), "doc_id").select("text", "toxic")


def mine_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Stems that mark toxic rows, from all labelled rows that are not held out."""
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).where("toxic in (0, 1)").dropDuplicates(["doc_id"])
    named = texts(docs).select("doc_id", F.sha2("text", 256).alias("name")).join(known, "doc_id")
    once = named.groupBy("name", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct()  # copies teach once
    both = labelled_texts(docs, materialize(once, "labelled"))
    schema = pa.schema([("stem", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches):
        tally, form = Tally(), np.zeros((2, PATTERNS + 1), np.int64)
        for part in slices(batches):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                found = split(text)
                words = Counter(found)
                tally.add(words, len(found), toxic)
                form[toxic, [PATTERNS, *forms(text, words, len(found))]] += 1
            if len(tally.number) > STEMS:
                yield from tally.batches(schema)
                tally = Tally()
        yield from tally.batches(schema)
        yield pa.RecordBatch.from_arrays([pa.array([f" {j}" for j in range(PATTERNS + 1)]), pa.array(form[1]), pa.array(form[0])], schema=schema)

    found = both.mapInArrow(count, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = materialize(found, "stems")
    form = np.zeros((2, PATTERNS + 1))
    for stem, pos, neg in found.where("stem like ' %'").collect():  # PATTERNS + 1 rows
        form[:, int(stem)] = neg, pos
    n_neg, n_pos = form[:, PATTERNS].tolist()
    shown, rows = form[:, :PATTERNS], form[:, PATTERNS]
    if not n_pos or not n_neg:
        return Lexicon([], [], shown, rows)
    share = n_pos / (n_pos + n_neg)
    k, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg")
    # Chernoff: chance of so many toxic rows among k, if the stem had nothing to do with the class
    evidence = pos * F.log(pos / k / share) + F.when(neg > 0, neg * F.log(neg / k / (1 - share))).otherwise(0.0)
    stems_tried = found.count()
    signs = found.where("stem not like ' %' and pos > 0").select("stem", "pos", "neg", evidence.alias("evidence"),
                                                                 (pos / n_pos / ((neg + 1) / (n_neg + 2))).alias("odds"))
    signs = materialize(signs.where((F.col("odds") > SIGN) & (F.col("evidence") > float(np.log(max(stems_tried, 1)) + MARGIN))), "signs")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        """Of stems that begin alike, the one with most evidence."""
        taken, chosen = [], []
        for i, stem in enumerate(rows.sort_values(["evidence", "stem"], ascending=[False, True], ignore_index=True)["stem"]):
            bare = stem.rstrip("!").rstrip("-")
            if not any(bare.startswith(t) or t.startswith(bare) for t in taken):
                taken.append(bare)
                chosen.append(i)
        return rows.sort_values(["evidence", "stem"], ascending=[False, True], ignore_index=True).loc[chosen, ["stem", "pos", "neg"]]

    beginning = F.substring(F.regexp_replace("stem", "[-!]+$", ""), 1, 4)
    voting = signs.where(F.col("odds") > LIKELIHOOD).groupBy(beginning).applyInPandas(best, "stem string, pos long, neg long")
    voters = sorted(tuple(r) for r in materialize(voting, "voters").collect())
    own = {v[0] for v in voters}
    more = [r[0] for r in signs.orderBy(F.desc("evidence"), "stem").select("stem").limit(FEATURES).collect()]
    return Lexicon(voters, [s for s in more if s not in own], shown, rows)


def mark(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, marks) of every document: ascending numbers of its marks."""
    schema = pa.schema([("doc_id", pa.int64()), ("marks", pa.list_(pa.int32()))])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.number)
    marker: list[Marker] = []

    def run(part: pa.RecordBatch) -> dict:
        if not marker:
            marker.append(Marker(shared.value))
        return {"doc_id": part.column("doc_id"), "marks": [marks_of(t, marker[0]) for t in part.column("text").to_pylist()]}

    return map_texts(texts(docs), run, schema, "doc_id long, marks array<int>")


def marks_of(text: str, marker: Marker) -> list[int]:
    found = split(text)
    words = Counter(found)
    return sorted([*forms(text, words, len(found)), *marker(words, len(found))])


class LabelModel:
    """P(voter fires | class), prior, and how much of its say each voter keeps."""

    def __init__(self, lexicon: Lexicon):
        n_neg, n_pos = lexicon.rows
        self.prior = float(np.clip(n_pos / max(n_neg + n_pos, 1), 1e-4, 0.5))
        self.fires = (lexicon.fired + 0.5) / (lexicon.rows[:, None] + 1)
        self.intercept = float(np.log(self.prior / (1 - self.prior)))
        self.say = np.ones(self.fires.shape[1])

    def posterior(self, votes: pa.ListArray) -> np.ndarray:
        """Of lists of voters' numbers."""
        f = np.clip(self.fires, 1e-6, 1 - 1e-6)
        weight = np.log(f[1] / f[0]) * self.say
        z = np.bincount(rows_of(votes), weights=weight[votes.flatten().to_numpy()], minlength=len(votes)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _together(votes: pa.ListArray, weights: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(i, j, summed class weights) of the voters i < j that fire in one row."""
    sizes = votes.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = votes.flatten().to_numpy().astype(np.int64), np.cumsum(sizes)
    after = np.repeat(ends, sizes) - np.arange(len(flat)) - 1
    i = np.repeat(np.arange(len(flat)), after)
    j = np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after) + i + 1
    key, where = np.unique(flat[i] * width + flat[j], return_inverse=True)
    row = rows_of(votes)[i]
    return key // width, key % width, *(np.bincount(where, weights=w[row], minlength=len(key)) for w in weights)


def fit_label_model(votes: DataFrame, lexicon: Lexicon) -> LabelModel:
    """EM over all documents; each round sums class weights and fires of the
    voters inside the tasks and adds the sums up (two numbers a voter go to
    the driver).  Joint fires stay on the executors.  The labelled rows stay
    in as pseudo-rows, which keeps the hidden class the toxic one."""
    model = LabelModel(lexicon)
    count = len(model.say)
    patterns = materialize(votes.groupBy("votes").count(), "votes")

    def weigh(batch, model):
        p, n = model.posterior(batch.column("votes")), batch.column("count").to_numpy()
        return (1 - p) * n, p * n

    for turn in range(ROUNDS):
        def expect(batches, model=model):
            sums = np.zeros((2, count + 1))
            for batch in batches:
                at, voter = rows_of(batch.column("votes")), batch.column("votes").flatten().to_numpy()
                for c, w in enumerate(weigh(batch, model)):
                    sums[c, -1] += w.sum()
                    sums[c, :-1] += np.bincount(voter, weights=w[at], minlength=count)
            at = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["at", "neg", "pos"])

        sums = np.zeros((2, count + 1))
        for at, neg, pos in patterns.mapInArrow(expect, "at long, neg double, pos double").groupBy("at").agg(F.sum("neg"), F.sum("pos")).collect():
            sums[:, at] = neg, pos
        fired, mass = sums[:, :-1], sums[:, -1:]
        if not mass.min() > 0:
            break
        f = np.clip(fired / mass, 1e-9, 1 - 1e-9)
        spread = np.sqrt(f * (1 - f))
        before, anchor = model, ANCHOR * np.maximum(mass, 1) / np.maximum(lexicon.rows[:, None], 1)
        model = LabelModel(lexicon)
        model.say = before.say
        model.intercept = before.intercept + np.clip(np.log(model.prior / (1 - model.prior)) - np.log(mass[1, 0] / mass[0, 0]), -2, 2)
        model.fires = (fired + anchor * lexicon.fired + 0.5) / (mass + anchor * lexicon.rows[:, None] + 1)
        if turn not in TIE_ROUNDS:
            continue
        worth = model.fires[1] * np.maximum(np.log(model.fires[1] / model.fires[0]), 1e-3) + 1e-9

        def meet(batches, model=before):
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _together(part.column("votes"), weigh(part, model), count)],
                                                     ["i", "j", "neg", "pos"])

        def tie(batches, f=f, spread=spread, mass=mass, worth=worth):
            for batch in batches:
                i, j, neg, pos = (c.to_numpy() for c in batch.columns)
                tied = np.min([np.abs(s / m - x[i] * x[j]) / (d[i] * d[j]) for s, m, x, d in
                               zip((neg, pos), mass[:, 0], f, spread, strict=True)], axis=0)  # in both classes
                at = np.flatnonzero(tied > 0.3)
                i, j, tied = i[at], j[at], np.minimum(tied[at], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, j]), pa.array(np.r_[tied * worth[j], tied * worth[i]])], ["at", "others"])

        pairs = patterns.mapInArrow(meet, "i long, j long, neg double, pos double").groupBy("i", "j").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        others = np.zeros(count)
        for at, x in pairs.mapInArrow(tie, "at long, others double").groupBy("at").agg(F.sum("others")).collect():  # a row a voter
            others[at] = x
        model.say = worth / (worth + others)
    return model


def train(rows: DataFrame, marks: int, prior: float) -> tuple[np.ndarray, float]:
    """Weight of each mark in the sparse linear classifier on (marks, p), and
    its bias for a corpus in which toxic documents have the share ``prior``."""
    schema = pa.schema([("mark", pa.int64()), ("weight", pa.float64())])

    def fit(batches):
        data = [(np.array(x, np.int64), p) for b in batches for x, p in zip(b.column("marks").to_pylist(), b.column("p").to_pylist(), strict=True)]
        mass = np.array([sum(1 - p for _, p in data), sum(p for _, p in data)])
        order = np.random.default_rng(1).permutation(len(data))
        w, seen, bias = np.zeros(marks), np.full(marks, 1e-3), 0.0
        for _ in range(EPOCHS):
            for i in order:
                x, p = data[i]
                g = 1 / (1 + np.exp(-np.clip(w[x].sum() + bias, -30, 30))) - p
                bias -= 0.02 * g
                seen[x] += g * g
                step = RATE / np.sqrt(seen[x])
                moved = w[x] - step * g
                w[x] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1 * abs(g), 0)
        bias += np.log(prior / (1 - prior)) - np.log((mass[1] + 1) / (mass[0] + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[bias, w[at]])], schema=schema)

    out, bias = np.zeros(marks), np.log(prior / (1 - prior))
    for mark_, weight in rows.coalesce(1).mapInArrow(fit, "mark long, weight double").collect():  # a row a mark
        if mark_ < 0:
            bias = weight
        else:
            out[mark_] = weight
    return out, float(bias)


def _sample(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of their id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


class Model:
    """Numbers of the marks, their weights, and the bias."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, bias: float):
        self.number, self.weights, self.bias = number, weights, bias

    def scores(self, marks: pa.ListArray) -> np.ndarray:
        z = np.bincount(rows_of(marks), weights=self.weights[marks.flatten().to_numpy()], minlength=len(marks)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, learned from ``docs`` without held-out rows, and the
    (doc_id, marks) of every row of ``docs``."""
    lexicon = mine_lexicon(docs, labels)
    marked = materialize(mark(docs, lexicon), "marked")
    voters = lexicon.voters
    voted = marked.withColumn("votes", F.filter("marks", lambda m: m < voters))
    model = fit_label_model(voted, lexicon)

    def judge(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("marks"), pa.array(model.posterior(b.column("votes")))], ["doc_id", "marks", "p"])

    posterior = voted.where(~held_out()).dropDuplicates(["doc_id"]).mapInArrow(judge, "doc_id long, marks array<int>, p double")
    sample = materialize(_sample(posterior.where("p > 0.5"), POSTERIOR).union(_sample(posterior.where("p <= 0.5"), POSTERIOR)), "sample")
    return Model(lexicon.number, *train(sample, PATTERNS + len(lexicon.number), model.prior)), marked


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model alone."""
    return learn(docs, labels)[0]


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> score."""
    shared = spark.sparkContext.broadcast(model)
    marker: list[Marker] = []

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        if not marker:
            marker.append(Marker(shared.value.number))
        return pd.Series(shared.value.scores(pa.array([marks_of(t, marker[0]) for t in text], pa.list_(pa.int32()))))

    return lambda column: of(F.coalesce(column, F.lit("")))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model, marked = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(b.column("marks")))], ["doc_id", "score"])

    scored = marked.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
