"""A hidden Markov language model: Baum-Welch counts summed over all training texts, exact forward scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts as tx
from sievework.llm.sampling import bounded_sample
from sievework.sources.stage import staged

#: Latent states; words that are symbols of their own; buckets of all other words; words whose counts travel with the job.
STATES, OWN, BUCKETS, COMMON = 8, 16_384, 4_096, 131_072
END = OWN + BUCKETS
SYMBOLS = END + 1
#: Passes of Baum-Welch over all training texts, after rounds on a bounded sample that set the start.
PASSES, SAMPLE_ROUNDS, SAMPLE_TEXTS, SAMPLE_TOKENS = 2, 12, 1_000, 2_000
#: Tokens whose forward variables are held at a time (a longer text alone).
HELD = 1_000_000
#: Weight of the symbols' overall shares in each state's emissions.
PRIOR = 200.0


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # SYMBOLS x STATES


class Layout:
    """Texts side by side, longest first, one token of each per step."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        ranked = sizes[self.order]
        steps = int(ranked[0]) if len(ranked) else 0
        self.active = np.searchsorted(-ranked, -np.arange(1, steps + 1), "right")  # texts with a token at each step
        self.at = np.concatenate([[0], np.cumsum(self.active)])

    def places(self, sizes: np.ndarray) -> np.ndarray:
        """Where each token, in text order, stands step by step."""
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        first = np.concatenate([[0], np.cumsum(sizes)])
        step = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
        return self.at[step] + np.repeat(rank, sizes)


def forward(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each text's symbols, by the scaled forward recursion."""
    lay = Layout(sizes)
    out = np.zeros(len(sizes))
    if not len(symbols):
        return out
    ordered = np.empty(len(symbols), np.int64)
    ordered[lay.places(sizes)] = symbols
    emit = model.emit
    a = model.start * emit[ordered[: lay.active[0]]]
    logs = np.zeros(len(sizes))
    for t, n in enumerate(lay.active):
        if t:
            a = (a[:n] @ model.move) * emit[ordered[lay.at[t] : lay.at[t + 1]]]
        scale = a.sum(axis=1)
        a /= scale[:, None]
        logs[:n] += np.log(scale)
    out[lay.order] = logs
    return out


def expected(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the texts (the E step)."""
    starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
    lay = Layout(sizes)
    if not len(symbols):
        return starts, moves, emits
    ordered = np.empty(len(symbols), np.int64)
    ordered[lay.places(sizes)] = symbols
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    seen = emit[ordered]
    alpha = np.empty((len(symbols), STATES), np.float32)
    scale = np.empty(len(symbols), np.float32)
    a = None
    for t, n in enumerate(lay.active):
        here = slice(lay.at[t], lay.at[t + 1])
        a = (model.start.astype(np.float32) if a is None else a[:n] @ move) * seen[here]
        scale[here] = s = a.sum(axis=1)
        a = a / s[:, None]
        alpha[here] = a
    beta = None
    for t in range(len(lay.active) - 1, -1, -1):
        n, here = lay.active[t], slice(lay.at[t], lay.at[t + 1])
        now = np.ones((n, STATES), np.float32)
        if beta is not None:
            m = len(beta)
            after = slice(lay.at[t + 1], lay.at[t + 2])
            ahead = seen[after] * beta / scale[after][:, None]
            moves += alpha[here][:m].T @ ahead
            now[:m] = ahead @ move.T
        beta = now
        alpha[here] *= beta  # now the posterior of the states
    moves *= model.move
    starts += alpha[: lay.active[0]].sum(axis=0)
    for s in range(STATES):
        emits[:, s] = np.bincount(ordered, weights=alpha[:, s], minlength=SYMBOLS)
    return starts, moves, emits


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    """The M step; every symbol keeps a share of each state by its share in all tokens."""
    start = (starts + 1) / (starts.sum() + STATES)
    move = (moves + 1) / (moves.sum(axis=1, keepdims=True) + STATES)
    emit = (emits + PRIOR * share[:, None]) / (emits.sum(axis=0) + PRIOR)
    return Model(start, move, emit)


class Lexicon:
    """Symbols and counts of the most frequent words."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
        self.words = pa.concat_arrays([c.cast(pa.large_binary()) for c in table["word"].chunks] or [pa.array([], pa.large_binary())])
        self.counts = table["n"].to_numpy()

    def find(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words (-1: none) and symbol of each word."""
        at = pc.fill_null(pc.index_in(unique, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return at, np.where((at >= 0) & (at < OWN), at, OWN + buckets(unique))


def buckets(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    return (tx.mix(tx.poly(*tx.raw(words))) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches):
    for _, texts in tx.parts(batches, limit=4_000_000):
        numbered = tx.words(*tx.raw(texts), lower=True).array().dictionary_encode()
        n = np.bincount(numbered.indices.to_numpy(), minlength=len(numbered.dictionary))
        yield pa.RecordBatch.from_arrays([numbered.dictionary.cast(pa.binary()), pa.array(n.astype(np.int64))], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of every word of ``texts``; each slice of a task sends a word once."""
    return texts.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _common(counts: DataFrame) -> DataFrame:
    """The most frequent words, at most COMMON: those above the least count for which there are no more."""
    step = F.floor(F.log2("n") * 32).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # 32 rows for each doubling of a count
    room, least = COMMON, 1 << 30
    for r in sorted(steps, key=lambda r: -r.step):
        room -= r.words
        if room < 0:
            break
        least = r.step
    return counts.where(step >= least)


def _encoded(lexicon):
    """Symbols of each text, its known part among frequent words, and its rare words with their counts."""

    def run(batches):
        lex = lexicon.value
        logs = np.log10(lex.counts + 1.0)
        for batch, texts in tx.parts(batches, limit=4_000_000):
            w = tx.words(*tx.raw(texts), lower=True)
            numbered = w.array().dictionary_encode()
            which = numbered.indices.to_numpy()
            at, symbol = lex.find(numbered.dictionary)
            log = np.where(at >= 0, logs[np.maximum(at, 0)] if len(logs) else 0.0, 0.0)
            place, first = at[which], w.first
            log_sum = np.concatenate([[0.0], np.cumsum(log[which])])
            mid_sum = np.concatenate([[0.0], np.cumsum(np.where(at >= OWN, log, 0.0)[which])])
            # symbols of each text and its end
            n = w.counts + 1
            ends = np.cumsum(n) - 1
            seq = np.empty(int(n.sum()), np.uint16)
            body = np.ones(len(seq), bool)
            body[ends] = False
            seq[body], seq[ends] = symbol[which], END
            seqs = tx.binary(seq.view(np.uint8), np.concatenate([[0], 2 * np.cumsum(n)])).cast(pa.binary())
            # rare words: distinct ones of each text
            rare = np.flatnonzero(place < 0)
            key = w.rows[rare] * len(numbered.dictionary) + which[rare]
            pair, times = np.unique(key, return_counts=True)
            row, word = np.divmod(pair, max(1, len(numbered.dictionary)))
            ends_of = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([numbered.dictionary.cast(pa.binary()).take(pa.array(word)), pa.array(times.astype(np.int64))], names=["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(tx.sums(place >= 0, first)),
                 pa.array(log_sum[first[1:]] - log_sum[first[:-1]]), pa.array(mid_sum[first[1:]] - mid_sum[first[:-1]]), seqs,
                 pa.ListArray.from_arrays(pa.array(ends_of), structs)],
                names=["doc_id", "held_out", "n_tokens", "known", "log", "mid_log", "symbols", "rare"],
            )

    return run


_ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, known long, log double, mid_log double, symbols binary, "
    "rare array<struct<word:binary,times:long>>"
)


def _groups(batches):
    """Symbol sequences of about HELD tokens at a time, with the rows they belong to."""
    rows, seqs, held = [], [], 0
    for batch in batches:
        for i, s in enumerate(batch.column("symbols")):
            rows.append((batch, i))
            seqs.append(np.frombuffer(s.as_buffer(), "<u2"))
            held += len(seqs[-1])
            if held >= HELD:
                yield rows, seqs
                rows, seqs, held = [], [], 0
    if seqs:
        yield rows, seqs


def _sizes(seqs) -> np.ndarray:
    return np.array([len(s) for s in seqs], np.int64)


def _e_step(model):
    def run(batches):
        starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
        some = False
        for _, seqs in _groups(batches):
            some = True
            for total, part in zip((starts, moves, emits), expected(model.value, np.concatenate(seqs), _sizes(seqs)), strict=True):
                total += part
        if some:  # rows 0.. are symbols, -1 the starts, -2.. the moves from each state
            used = np.flatnonzero(emits.any(axis=1))
            table = np.concatenate([emits[used], starts[None], moves])
            row = np.concatenate([used, [-1], -2 - np.arange(STATES)])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *(pa.array(table[:, s]) for s in range(STATES))], names=["row", *(f"s{s}" for s in range(STATES))])

    return run


def _trained(encoded: DataFrame, texts: int) -> Model:
    """Baum-Welch over all training texts, from a start found on a bounded sample."""
    spark = encoded.sparkSession
    train = encoded.where(~F.col("held_out"))
    rng = np.random.default_rng(1)
    sample = bounded_sample(train.where(F.col("n_tokens") <= SAMPLE_TOKENS), "symbols", SAMPLE_TEXTS, texts)
    seqs = [np.frombuffer(r.symbols, "<u2") for r in sample.collect()]
    share = np.ones(SYMBOLS)
    for s in seqs:
        share += np.bincount(s, minlength=SYMBOLS)
    share /= share.sum()
    noise = rng.dirichlet(np.full(STATES, 2.0), SYMBOLS) * share[:, None] * 1e6
    model = maximised(np.ones(STATES), np.eye(STATES) * 50 + 1, noise, share)
    if seqs:
        sizes, flat = _sizes(seqs), np.concatenate(seqs)
        for _ in range(SAMPLE_ROUNDS):
            model = maximised(*expected(model, flat, sizes), share)
    kinds = "row long, " + ", ".join(f"s{s} double" for s in range(STATES))
    for _ in range(PASSES):
        parts = train.select("symbols").mapInArrow(_e_step(spark.sparkContext.broadcast(model)), kinds)
        got = parts.groupBy("row").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES))).toPandas()
        table = np.zeros((SYMBOLS + 1 + STATES, STATES))
        table[got.row.to_numpy()] = got[[f"s{s}" for s in range(STATES)]].to_numpy()  # negative rows count from the end
        emits, starts, moves = table[:SYMBOLS], table[-1], table[-2 : -2 - STATES : -1]
        share = (emits.sum(axis=1) + 1) / (emits.sum() + SYMBOLS)
        model = maximised(starts, moves, emits, share)
    return model


def _scored(model, room):
    """Forward score in log10, less the logarithms of the room in the buckets that the text's words share."""

    def run(batches):
        log_room = np.zeros(SYMBOLS)
        log_room[OWN:END] = np.log10(room.value)
        for rows, seqs in _groups(batches):
            sizes, flat = _sizes(seqs), np.concatenate(seqs)
            score = forward(model.value, flat, sizes) / np.log(10)
            score -= np.add.reduceat(log_room[flat], np.concatenate([[0], np.cumsum(sizes)])[:-1])
            whole = pa.concat_batches(_rows(rows))
            names = ["row", "doc_id", "held_out", "n_tokens", "known", "log", "mid_log"]
            yield pa.RecordBatch.from_arrays([*(whole.column(n) for n in names), pa.array(score)], names=[*names, "model"])

    return run


def _rows(rows):
    """The batches' slices that hold the rows, in order."""
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] is not rows[start][0]:
            batch, first = rows[start]
            yield batch.slice(first, i - start)
            start = i


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` scored by a model of the rows that are not held out.

    Tokens are the lower-cased (A-Z) words and one end.  ``base_score`` is the add-one unigram score from exact counts of all training
    tokens.  ``score`` is the log10 probability of the text under an HMM: a state emits one of the
    16,384 most frequent words, one of 4,096 buckets of all other words, or the end; a word in a
    bucket has the probability (c + 1) / (C + V + 1), with C tokens and V words of the bucket in training, and one
    share for all unseen words.  Expected counts are summed over all training texts, whole sequences each, in
    every pass; the forward recursion is exact and scaled, in double precision.

    Counts of the most frequent words, at most 131,072, travel with the job, a fixed bound; each text's other words meet their
    counts in a join.  A null or empty text is the end alone.  A null id counts as an empty text for the
    split.  Repeated rows and ids are texts of their own; an empty table gives no rows; without training texts
    all counts are 0.  Other columns are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    counts = staged(word_counts(narrow.where(~F.col("held_out")).select("text")))
    texts = narrow.where(~F.col("held_out")).count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = words + texts, kinds + (texts > 0)

    lexicon = spark.sparkContext.broadcast(Lexicon(_common(counts).toArrow()))
    encoded = staged(narrow.mapInArrow(_encoded(lexicon), _ENCODED).withColumn("row", F.monotonically_increasing_id()))
    model = spark.sparkContext.broadcast(_trained(encoded, texts))

    own = lexicon.value.words.slice(0, OWN)

    def bucketed(batches):
        for batch in batches:
            word = batch.column("word").cast(pa.large_binary())
            other = pc.invert(pc.is_in(word, value_set=own))
            yield pa.RecordBatch.from_arrays([pa.array(buckets(word.filter(other))), batch.column("n").filter(other)], names=["bucket", "n"])

    full = counts.mapInArrow(bucketed, "bucket long, n long").groupBy("bucket").agg((F.sum("n") + F.count("*")).alias("room"))
    room = np.ones(BUCKETS)
    for r in full.collect():
        room[r.bucket] += r.room
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "log", "mid_log", "symbols")
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, log double, mid_log double, model double"
    scored = scored.mapInArrow(_scored(model, spark.sparkContext.broadcast(room)), kinds)

    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    n = F.coalesce("n", F.lit(0))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + 1.0)).alias("rare_log"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if texts else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log") + rare_log + F.lit(float(np.log10(texts + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"),
        (F.col("model") + F.col("mid_log") + rare_log).alias("score"),
    )
