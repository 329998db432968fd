"""Mixture-controlled packing into fixed windows.

Every source is a queue of tokens.  Deficit round-robin gives each window a
quota per source; what rounding withholds from a source is its deficit and is
paid in a later window.  The deficits after any window have a closed form
(divisor method: the ``W * window`` tokens that come first when token ``j`` of
a queue of weight ``w`` is due at ``(j + 1/2) / w``), so every task computes
the quotas of its own windows and deficits carry across windows and
partitions without a sequential pass.  A queue that runs dry starts a new
phase, in which the other queues share by their weights.

Token ids are made once, written as 16- or 32-bit numbers beside each
document's place in its queue, and cut into pieces where they lie: only
per-task token counts per source move between tasks, as a written table.

Beyond some number of sources those without a target make one queue together,
in the order in which their tokens are due: a distributed sort ranks the
tokens, and the same divisor method says which window takes which ranks.

Defined results: a null text is empty and yields the end id alone; repeated
rows are packed once each; a null source is a queue of its own; an empty table
yields no piece.
"""

from __future__ import annotations

import itertools
import math
import os
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warung.llm import textscan as S
from warung.llm.store import saved

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, source string")


# ---------------------------------------------------------------- tokenizer
MARKS = ".,;:!?"
_IS_MARK = np.isin(np.arange(256), list(MARKS.encode()))
_IS_LETTER = np.isin(np.arange(256), list(string.ascii_lowercase.encode()))
TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<>")    # a run of these after a letter is a piece, too
PROBE = (" The  quick (brown) fox,\n\tdidn't JUMP over 13.5 dogs; \u00c9t\u00e9 na\u00efve! e-mail: a_b@c.de <x> "
         + " ".join(f"end{chr(c)} end{chr(c) * 3} \u00e9t\u00e9{chr(c)}{chr(33 + c % 6)}" for c in TAIL))


class WordTokenizer:
    """Token ids per word from the ``tokenizers`` library, with a bounded cache.

    The vocabulary drops white space, so the ids of a text are those of its
    words one after the other; a letter before a mark of punctuation ends a
    piece, so a word's last mark (or run of marks, when it is new) is looked up
    by itself.  New words made of
    letters are tokenized many at a time and told apart by their closing
    tokens; those of ASCII letters, lower-cased, go straight to the library's
    model if that gives the same ids.  Two generations of ``room`` words keep
    what is frequent; a word that fell out is tokenized again.
    """

    def __init__(self, path: str, room: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.room, self.young, self.old = room, {}, {}
        self.marks = {m.encode(): self._one([m])[0] for m in MARKS}
        # the same model without what leaves lower-cased ASCII words as they are
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        known = sorted(t for t in (t.removesuffix("</w>") for t in vocabulary) if t.isascii() and t.isalpha() and t.islower())[::20]
        tried = " ".join([string.ascii_lowercase, *known, *(a + b for a, b in itertools.pairwise(known))])
        if self._ids(self.plain, tried) != self._ids(self.library, tried):
            self.plain = self.library
        # another kind of vocabulary (one that keeps spaces, say) gets whole texts
        self.whole = False
        self.whole = not self.closing.any() or self.batch([PROBE.encode()]) != self._one([PROBE])

    def _one(self, words: list[str]) -> list[bytes]:
        made = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]

    @staticmethod
    def _ids(library, text: str) -> list[int]:
        return library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _many(self, words: list[bytes], library) -> list[bytes]:
        """Ids of words of letters only."""
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            some = words[at:at + 512]             # neighbours share merges if sorted
            ids = np.array(self._ids(library, b" ".join(some).decode()), dtype="<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(some):            # a letter whose lower case is no letter alone
                out += self._one([w.decode() for w in some])
                continue
            flat, cuts = ids.tobytes(), (4 * ends).tolist()
            out += [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def _learn(self, words: Iterable[bytes]) -> None:
        """Adds the ids of words that are not in the young generation."""
        young, old, marks = self.young, self.old, self.marks
        ascii_, letters, others, marked = set(), set(), set(), []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif w.isalpha():                     # of ASCII letters
                ascii_.add(w)
            elif (core := w.rstrip(TAIL)).isalpha() or core.decode().isalpha():
                if core == w:
                    letters.add(w)
                    continue
                tail = w[len(core):]
                marked.append((w, core, tail))
                for part, kind in ((core, ascii_ if core.isascii() else letters), (tail, others)):
                    if part in old:
                        young[part] = old[part]
                    elif part not in young and part not in marks:
                        kind.add(part)
            else:
                others.add(w)
        for some, library in ((sorted(ascii_), self.plain), (sorted(letters), self.library)):
            young.update(zip(some, self._many([w.lower() for w in some], library), strict=True))
        if others:
            young.update(zip(others, self._one([w.decode() for w in others]), strict=True))
        for w, core, tail in marked:
            young[w] = young[core] + (marks.get(tail) or young[tail])

    def forget(self) -> None:
        """Lets go of the words."""
        self.young, self.old = {}, {}

    def batch(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.whole:
            return self._one([(t or b"").decode("utf-8", "replace") for t in texts])
        which, words, counts = _words(texts)
        young = self.young
        found = list(map(young.get, words))
        if new := [k for k, ids in enumerate(found) if ids is None]:
            self._learn(words[k] for k in new)
            for k in new:
                found[k] = young[words[k]]
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[which])])
        ids = ids[np.repeat(first[which] - ends[:-1], size[which]) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [ids[a:b].tobytes() for a, b in itertools.pairwise(cuts)]
        if len(young) > self.room:
            self.old, self.young = young, {}
        return out


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The texts' words one after the other as indices into a list of different
    ones, that list, and each text's number of words.  A mark at a word's end,
    after one of a-z, is a word of its own.

    A marker of special tokens is case-sensitive, so texts with one stay as they
    are; everything else is lower-cased by the vocabulary's own normaliser."""
    marker = np.array([b"<|" in (t or b"") for t in texts], dtype=bool)
    raw = S.as_array(b"\n".join([t or b"" if m else (t or b"").lower() for t, m in zip(texts, marker.tolist(), strict=True)]))
    starts, ends = S.word_spans(raw)
    limits = np.cumsum([len(t or b"") + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    cut = (ends - starts > 1) & _IS_MARK[raw[ends - 1]]
    cut[cut] = _IS_LETTER[raw[ends[cut] - 2]]
    if marker.any():
        cut &= ~np.repeat(marker, counts)
    counts = np.diff(np.cumsum(np.append(0, cut))[np.cumsum(counts)], prepend=0) + counts
    lengths = np.repeat(ends - starts, 1 + cut)
    second = np.flatnonzero(cut) + np.arange(1, cut.sum() + 1)
    lengths[second - 1] -= 1
    lengths[second] = 1
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    letters = raw[~S._SPACE[raw]]
    coded = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), counts


_tokenizers: dict[str, WordTokenizer] = {}
S.kept["packing"] = _tokenizers.clear


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# ----------------------------------------------------------------- schedule
@dataclass(frozen=True)
class Phase:
    """``count`` windows from ``first`` on, shared by ``weights``; ``before``
    tokens of each queue are already placed."""
    first: int
    count: int
    weights: np.ndarray
    before: np.ndarray


def placed(phase: Phase, windows: np.ndarray, window: int) -> np.ndarray:
    """Tokens of each queue placed in the phase's first ``windows`` windows
    (array in, one row per entry out), by the divisor method."""
    w = phase.weights.astype(np.float64)
    live = w > 0
    share = np.where(live, w / w.sum(), 0.0)
    seats = windows.astype(np.int64) * window
    n = np.floor(seats[:, None] * share + 0.5).astype(np.int64) * live
    safe = np.where(live, w, 1.0)
    rows = np.arange(len(seats))
    while True:                                   # at most len(w) / 2 + 1 steps
        gap = seats - n.sum(axis=1)
        low, high = gap > 0, gap < 0
        if not low.any() and not high.any():
            return n
        if low.any():
            due = np.where(live, (n + 0.5) / safe, np.inf)
            n[rows[low], due.argmin(axis=1)[low]] += 1
        if high.any():
            last = np.where(live & (n > 0), (n - 0.5) / safe, -np.inf)
            last = last[:, ::-1]                  # of equal times the last queue gives way
            n[rows[high], len(w) - 1 - last.argmax(axis=1)[high]] -= 1


def schedule(totals: np.ndarray, weights: np.ndarray, window: int) -> list[Phase]:
    """Phases that place every token; at most two per queue, the last window
    of all may be short."""
    phases: list[Phase] = []
    done = np.zeros(len(totals), dtype=np.int64)
    first = 0
    while (left := totals - done).any():
        live = left > 0
        w = np.where(live, weights, 0).astype(np.float64)
        if not w.sum():
            w = left.astype(np.float64)
        if left.sum() <= window:                  # the last window takes what is left
            phases.append(Phase(first, 1, np.zeros(0), done + left))
            break
        quota = w / w.sum() * window
        paid = live & (w > 0)
        count = int((left[paid] / quota[paid]).min())
        if np.allclose(left / left.sum(), w / w.sum(), rtol=1e-12, atol=0):
            count, w = int(left.sum() // window), left.astype(np.float64)
        phase = Phase(first, count, w, done.copy())
        while count and (placed(phase, np.array([count]), window)[0] > left).any():
            count -= 1                            # rounding may want a token too many
        if count:
            phase = Phase(first, count, w, done.copy())
            phases.append(phase)
            done = done + placed(phase, np.array([count]), window)[0]
            first += count
            continue
        # one window in which queues that run dry give all they have
        take = np.zeros(len(totals), dtype=np.int64)
        room, open_ = window, live.copy()
        while True:
            ww = np.where(open_, w, 0)
            if not ww.sum():
                ww = np.where(open_, left, 0).astype(np.float64)
            want = placed(Phase(0, 1, ww, done), np.array([1]), room)[0]
            dry = open_ & (want >= left)
            if not dry.any():
                take[open_] = want[open_]
                break
            take[dry] = left[dry]
            open_ &= ~dry
            room = window - int(take.sum())
            if room <= 0 or not open_.any():
                break
        over = int(take.sum()) - window
        for k in np.flatnonzero(take)[::-1]:
            if over <= 0:
                break
            cut = min(over, int(take[k]))
            take[k] -= cut
            over -= cut
        phases.append(Phase(first, 1, np.zeros(0), done + take))
        done = done + take
        first += 1
    return phases


class Layout:
    """Where token ``j`` of queue ``s`` goes."""

    def __init__(self, totals: np.ndarray, phases: list[Phase], window: int):
        self.totals, self.phases, self.window = totals, phases, window

    def bounds(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue in the windows before each given window."""
        out = np.zeros((len(windows), len(self.totals)), dtype=np.int64)
        for p in self.phases:
            inside = np.clip(windows - p.first, 0, p.count)
            reach = inside > 0
            if not reach.any():
                continue
            if len(p.weights):
                out[reach] = p.before + placed(p, inside[reach], self.window)
            else:
                out[reach] = p.before             # a single spelled-out window
        return out

    def pieces(self, queue: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents lying at ``cuts[0] .. cuts[1] .. cuts[-1]`` in the
        queue: each piece's start in the queue, length, window and offset there."""
        low, high = int(cuts[0]), int(cuts[-1])
        windows = np.arange(self._window_near(queue, low, -2), self._window_near(queue, high, 2) + 1)
        edges = self.bounds(np.append(windows, windows[-1] + 1))
        while edges[0, queue] > low:
            windows = np.arange(max(windows[0] - 64, 0), windows[-1] + 1)
            edges = self.bounds(np.append(windows, windows[-1] + 1))
        while edges[-1, queue] < high:
            windows = np.arange(windows[0], windows[-1] + 65)
            edges = self.bounds(np.append(windows, windows[-1] + 1))
        mine = edges[:, queue]
        all_cuts = np.unique(np.concatenate([cuts, mine[(mine > low) & (mine < high)]]))
        begin, length = all_cuts[:-1], np.diff(all_cuts)
        at = np.searchsorted(mine, begin, side="right") - 1
        before = (edges[1:, :queue] - edges[:-1, :queue]).sum(axis=1)
        return begin, length, windows[at], before[at] + begin - mine[at]

    def _window_near(self, queue: int, token: int, slack: int) -> int:
        """The window that holds the token, or one nearby."""
        for p in self.phases:
            end = p.first + p.count
            reach = self.bounds(np.array([end]))[0, queue]
            if token < reach or (token == reach and slack > 0):
                if not len(p.weights) or not p.weights[queue]:
                    return max(p.first + slack, 0) if slack < 0 else end
                share = p.weights[queue] / p.weights.sum()
                at = int((token - p.before[queue]) / (share * self.window))
                # rounding keeps a queue within its count of queues of its share
                slip = math.ceil(len(self.totals) / (share * self.window))
                return max(0, p.first + min(max(at, 0), p.count) + slack + (slip if slack > 0 else -slip))
        return self.phases[-1].first + 1


# ------------------------------------------------------------------- the job
def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per document: ids, and its first token's place in the queue of
    its source within the task that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, placed_so_far = tokenizer(path), TaskContext.get().partitionId(), {}
        tail = np.array([end_id], dtype="<u4").tobytes()
        try:
            for batch in batches:
                for part, texts in S.texts_of(batch):
                    ids = [i + tail for a, b in S.bounded(texts) for i in encoder.batch(texts[a:b])]
                    starts = []
                    for source, one in zip(part.column("source").to_pylist(), ids, strict=True):
                        at = placed_so_far.get(source, 0)
                        starts.append(at)
                        placed_so_far[source] = at + len(one) // 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task] * len(ids), pa.int32()), part.column("doc_id"), part.column("source"),
                         pa.array(starts, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                        ["task", "doc_id", "source", "start", "n", "ids"])
                S.give_back()
        finally:                                  # idle workers are many: words stay for a task only
            encoder.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    return rows.mapInArrow(S.lean(run, "packing"), "task int, doc_id long, source string, start long, n long, ids binary")


def spread(spark: SparkSession, docs: DataFrame, shared, queue: int) -> DataFrame:
    """Pieces of the documents of many sources, which share one queue of the
    layout.  Token ``j`` of a source of ``total`` tokens is due at ``(j + 1/2) /
    total``, of equal times the first source's first; its rank in that order is
    its place in the queue.  The rows are tokens: with more sources than a window
    has tokens the average piece is no longer than one."""
    first = [F.col("source").isNull(), F.col("source")]
    each = docs.select("source", "low", "total", F.explode(F.sequence("low", F.col("low") + F.col("n") - 1)).alias("j"))
    line = each.withColumn("due", (F.col("j") + 0.5) / F.col("total")).orderBy("due", *first, "j")
    line = saved(spark, line.select("source", "low", "j", F.monotonically_increasing_id().alias("at")), "pack-line")
    part = F.shiftright("at", 33)
    sizes = line.groupBy(part.alias("part")).agg(F.count("*").alias("k")).orderBy("part").collect()   # a row per task of the sort
    before = np.cumsum([0, *(r["k"] for r in sizes)]).tolist()
    starts = spark.createDataFrame([(r["part"], k) for r, k in zip(sizes, before, strict=False)], "part long, before long")
    ranked = line.withColumn("part", part).join(F.broadcast(starts), "part")
    ranked = ranked.select("source", "low", "j", (F.col("before") + F.col("at").bitwiseAND(2**33 - 1)).alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value[1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            for run in np.split(np.arange(len(rank)), np.flatnonzero(np.diff(rank) != 1) + 1):
                if not len(run):
                    continue
                begin, _, windows, offset = layout.pieces(queue, np.array([rank[run[0]], rank[run[-1]] + 1]))
                at = np.searchsorted(begin, rank[run], side="right") - 1
                some = batch.slice(run[0], len(run))
                yield pa.RecordBatch.from_arrays(
                    [some.column("source"), some.column("low"), some.column("j"),
                     pa.array(windows[at], pa.int64()), pa.array(offset[at] + rank[run] - begin[at], pa.int64())],
                    ["source", "low", "j", "sequence_id", "seat"])

    seats = ranked.mapInArrow(seat, "source string, low long, j long, sequence_id long, seat long")
    found = seats.groupBy("source", "low", "sequence_id").agg(
        F.min("j").alias("j"), F.count("*").alias("length"), F.min("seat").alias("seat"))
    whole = W.partitionBy("sequence_id")                               # at most a window's tokens
    found = found.select(F.col("source").alias("_source"), F.col("low").alias("_low"), (F.col("j") - F.col("low")).alias("start"), "length", "sequence_id",
                         (F.min("seat").over(whole) + F.sum("length").over(whole.orderBy(*first, "low")) - F.col("length")).alias("offset"))
    met = found.join(docs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("low") == F.col("_low")))
    met = met.withColumn("ids", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
    return met.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                      "sequence_id", "offset", "source", "ids")


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, *, end_id: int = 2, window: int = 4096,
         targets: dict[str, float] | None = None, max_tasks: int = 10_000, max_sources: int | None = None, queues: int = 256,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, placed in windows of ``window`` tokens.

    ``targets`` are wanted token proportions by source (a source not named
    shares what is natural to it at weight 0 once the others are dry); by
    default the proportions of the corpus, so that every window holds the
    mixture of the whole.  ``max_tasks`` tasks tokenize.  Up to ``queues``
    sources are cut where they lie, with one number per source sent to the
    tasks; of more, those without a target are placed by ``spread`` (the same
    pieces if there are no targets; else the same tokens of every target in
    every window).  There may be any number of sources; a caller that wants an
    error beyond some number gives ``max_sources``.  With ``keep_ids`` the pieces carry their ids.
    """
    if docs.rdd.getNumPartitions() > max_tasks:
        docs = docs.coalesce(max_tasks)
    tokens = saved(spark, tokenized(docs, vocabulary, end_id, id_col, text_col, source_col), "pack-tokens")
    counts = tokens.groupBy("task", "source").agg(F.sum("n").alias("n"))
    by = W.partitionBy("source")                                       # a row per task
    offsets = saved(spark, counts.select(F.col("task").alias("_task"), F.col("source").alias("_source"),
                                         (F.sum("n").over(by.orderBy("task")) - F.col("n")).alias("base"),
                                         F.sum("n").over(by).alias("total")), "pack-offsets")
    sources = offsets.groupBy("_source").agg(F.first("total").alias("total"))
    if max_sources is not None and (found := sources.count()) > max_sources:
        raise ValueError(f"{found} sources; max_sources is {max_sources}")
    own = sources.limit(queues + 1).collect()
    named, rest = F.lit(True), []
    if len(own) > queues:
        known = F.col("source").isin([s for s in targets or {} if s is not None])
        named = F.when(F.col("source").isNull(), F.lit(None in (targets or {}))).otherwise(known)
        split = sources.withColumnRenamed("_source", "source").withColumn("named", named)
        own = split.where("named").collect()
        rest = [split.where("not named").agg(F.sum("total")).first()[0] or 0]
    own.sort(key=lambda r: (r[0] is None, r[0] or ""))
    place = {r[0]: k for k, r in enumerate(own)}
    totals = np.array([*(r["total"] for r in own), *rest], dtype=np.int64)
    weights = np.array([*(targets.get(s, 0.0) for s in place), *(0.0 for _ in rest)]) if targets else totals.astype(np.float64)
    shared = spark.sparkContext.broadcast((place, Layout(totals, schedule(totals, weights, window), window)))
    lying = tokens.join(offsets, (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_source")))
    lying = lying.select("doc_id", "source", (F.col("base") + F.col("start")).alias("low"), "n", "total", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, layout = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = part.column("n").to_numpy()
                ids = part.column("ids").to_pylist()
                queue = np.array([where[x] for x in part.column("source").to_pylist()])
                low = part.column("low").to_numpy()
                order = np.lexsort([low, queue])
                # runs of documents that follow one another in a queue
                breaks = (queue[order][1:] != queue[order][:-1]) | ((low + n)[order][:-1] != low[order][1:])
                for run in np.split(order, np.flatnonzero(breaks) + 1):
                    if not len(run):
                        continue
                    cuts = np.append(low[run], low[run[-1]] + n[run[-1]])
                    begin, length, windows, offset = layout.pieces(queue[run[0]], cuts)
                    row = run[np.searchsorted(cuts, begin, side="right") - 1]
                    start = begin - low[row]
                    pieces = [ids[r][4 * s:4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                    sums = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces))
                    columns = [start, length, sums, n[row], windows, offset]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns), part.column("source").take(pa.array(row)),
                         pa.array(pieces, pa.binary()) if keep_ids else pa.nulls(len(row), pa.binary())],
                        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"])

    pieces = lying.where(named).drop("total").mapInArrow(S.lean(cut, "packing"), PIECES + ", ids binary")
    if rest:
        pieces = pieces.unionByName(spread(spark, lying.where(~named), shared, len(own)))
    return pieces if keep_ids else pieces.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces made with ``keep_ids``:
    one row per window with its ids (little-endian 32-bit) in order.  A group
    holds one window, so it is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
