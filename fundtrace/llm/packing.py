"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous supersteps.

A document is its token ids and a closing id 0; only one longer than a sequence is cut, into whole sequences and
a rest. The largest pieces open sequences, as many as all pieces fill at least. Then supersteps follow: pieces and gaps
(the free ends of sequences) are range-sorted by size into partitions. Each partition is swept upwards: pieces wait in a
stack, and a gap takes from its top, so it gets the largest piece that it can hold, and two gaps never get one piece: their
rank in the sort decides. Gaps left without a piece look in the partitions below, nearest first; which stretch of
ranks of one partition meets which of another follows from the partitions' counts alone, and the rows meet in a join on their
ranks. Gaps shrink, and the next superstep begins; when no gap holds a piece any more, further sequences are opened.

The driver sees four numbers for each partition. Equal sizes are dealt to partitions by a random tie, so a size that much
of the input has fills no partition.

Null and empty texts are one id 0. Rows are placed one by one, whether doc_ids are missing or repeated. Empty table: no rows.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundtrace.llm.features import text_rows
from fundtrace.llm.store import KEPT, thrifty, written
from fundtrace.llm.text import LOWER, pieces as parts_of, word_hashes, word_spans

SEQUENCE = 2048
#: Units of text whose ids a Python worker keeps, at about 30 bytes each; it forgets them all when there are more.
KNOWN_UNITS = 1_000_000
#: Pieces and gaps in a partition of a sweep.
SWEPT_ROWS = 50_000
#: Sequences up to which exactly that many of a run of equal pieces are picked to open them.
FEW_OPENED = 10_000

_LOWER = np.frombuffer(LOWER, np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
LETTERS, MARKS, DIGITS, OTHER = 1, 2, 3, 4
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[c for c in range(0x21, 0x7F)]] = MARKS
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTERS
_CLASS[[*range(0x30, 0x3A)]] = DIGITS
_CLASS[[0x27, 0x3C]] = OTHER  # apostrophes join what follows, and special tokens begin with <
_CLASS[[0x20, 0x0A]] = 0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def units(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bytes, first, last, kind, number for each text): what the tokenizer surely encodes apart.

    Within a word (between spaces and newlines) runs of ASCII and common Latin letters, of digits and of ASCII marks are
    units; their ASCII letters become small, as the tokenizer does itself. A word with anything else is one unit as it is.
    """
    low = _LOWER[buf]
    cls = _CLASS[buf]
    lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5)) if len(buf) else np.zeros(0, np.int64)
    behind = buf[lead + 1]
    # Not the signs for times and divided by, nor the capital that becomes two characters.
    latin = ~((buf[lead] == 0xC3) & ((behind == 0x97) | (behind == 0xB7))) & ~((buf[lead] == 0xC4) & (behind == 0xB0))
    cls[lead[latin]] = cls[lead[latin] + 1] = LETTERS
    first, last, _ = word_spans(buf, starts, ends, _SPACE)
    others = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(cls == OTHER, out=others[1:])
    odd = others[last] > others[first]
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[first[odd]] += 1
    edge[last[odd]] -= 1
    whole = np.cumsum(edge[:-1], dtype=np.int32) > 0
    low[whole] = buf[whole]
    begin = np.zeros(len(buf), bool)
    begin[1:] = (cls[1:] != cls[:-1]) & (cls[1:] > 0) & (cls[:-1] > 0) & ~whole[1:]
    begin[first] = True
    f = np.flatnonzero(begin)
    end = np.minimum(np.r_[f[1:], len(buf)], last[np.searchsorted(first, f, "right") - 1]) if len(f) else f
    kind = np.where(whole[f], OTHER, cls[f])
    return low, f, end, kind, np.searchsorted(f, ends) - np.searchsorted(f, starts)


class UnitIds:
    """Token ids of units by their 64-bit hash, in flat arrays. A Python worker keeps it for its tasks, until it has one of another operator."""

    kept: dict[str, "UnitIds"] = KEPT.setdefault(__name__, {})

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hash, self.start, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, tokenizer: str) -> "UnitIds":
        if tokenizer not in cls.kept:
            cls.kept[tokenizer] = cls(tokenizer)
        return cls.kept[tokenizer]

    def places(self, h: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Place of each unit in the arrays, which learn those that aren't known."""
        different, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(different) > KNOWN_UNITS:
            self.forget()
        at = np.searchsorted(self.hash, different)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == different[known]
        if not known.all():
            self._learn(different[~known], *(x[one[~known]] for x in (first, last, kind)), low)
            at = np.searchsorted(self.hash, different)
        return at[inverse]

    def _learn(self, h, first, last, kind, low) -> None:
        order = np.argsort(kind, kind="stable")  # letters and marks first
        h, first, last, kind = h[order], first[order], last[order], kind[order]
        single = int(np.searchsorted(kind, DIGITS))
        ids, lengths = [], []
        for i in range(0, single, 2000):
            j = min(i + 2000, single)
            got = np.asarray(self.tokenizer.encode_batch_fast([_joined(low, first[i:j], last[i:j])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[got]) + 1
            if len(cut) == j - i and cut[-1] == len(got):
                ids.append(got)
                lengths.append(np.diff(np.r_[0, cut]))
            else:
                self._each(low, first[i:j], last[i:j], ids, lengths)
        for i in range(single, len(h), 2000):
            self._each(low, first[i : i + 2000], last[i : i + 2000], ids, lengths)
        length = np.concatenate(lengths).astype(np.int32)
        start = (len(self.ids) + np.cumsum(length) - length).astype(np.int32)
        self.ids = np.concatenate([self.ids, *ids])
        whole = np.concatenate([self.hash, h])
        order = np.argsort(whole, kind="stable")
        self.hash, self.start, self.length = whole[order], np.concatenate([self.start, start])[order], np.concatenate([self.length, length])[order]

    def _each(self, low, first, last, ids, lengths) -> None:
        words = [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(first.tolist(), last.tolist())]
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            ids.append(np.asarray(e.ids, np.uint32))
            lengths.append(np.array([len(e.ids)]))


def _joined(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> str:
    """low[first:last] of each pair, with spaces between."""
    n = last - first + 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    out = low[np.minimum(at, len(low) - 1)]
    out[np.cumsum(n) - 1] = 32
    return out.tobytes().decode("utf-8", "replace")


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        known = UnitIds.of(tokenizer)
        for b in batches:
            row = 0
            for _, buf, starts, ends in parts_of(pa.array(np.arange(len(b))), b.column("text")):
                low, first, last, kind, n = units(buf, starts, ends)
                place = known.places(word_hashes(low, first, last), low, first, last, kind)
                length = known.length[place].astype(np.int64)
                total = np.r_[0, np.cumsum(length)]
                until = np.cumsum(n)
                tokens = total[until] - total[until - n] + 1
                # Each text's ids, then a zero: a text's own ids are moved on by the zeros before them.
                ids = np.zeros(int(tokens.sum()), "<u4")
                to = np.repeat(np.repeat(np.arange(len(n)), n), length) + np.arange(total[-1])
                ids[to] = known.ids[np.repeat(known.start[place] - total[:-1], length) + np.arange(total[-1])]
                whole, begin = memoryview(ids.tobytes()), (np.cumsum(tokens) - tokens).tolist()
                of, k, crc = [], [], []
                for i, (a, t) in enumerate(zip(begin, tokens.tolist())):
                    for j, p in enumerate(range(a, a + t, size)):
                        of.append(i)
                        k.append(j)
                        crc.append(zlib.crc32(whole[4 * p : 4 * min(p + size, a + t)]))
                of, k = np.array(of, np.int64), np.array(k, np.int64)
                start = k * size
                out = [b.column("doc_id").take(pa.array(of + row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(np.minimum(size, tokens[of] - start)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names)
                row += len(n)

    return text_rows(docs).mapInArrow(thrifty(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


#: A row of a sweep: a piece that waits, or a gap (sequence_id not null) of that many free tokens.
STATE = "doc_id long, piece int, start long, size long, ids_crc32 long, sequence_id long, tie long"
SWEPT = STATE + ", role int, offset long, part int, rank long"
PLACED, SHRUNK, GAP, WAITING = range(4)


def sweep(size: np.ndarray, gap: np.ndarray, whole: int):
    """One partition in ascending order, pieces before gaps of their size: (role, of, offset).

    of: for a placed piece the row of its gap; offset: where it begins there; a shrunk gap's offset is the size left.
    """
    role, of, offset = np.where(gap, GAP, WAITING), np.full(len(size), -1), np.zeros(len(size), np.int64)
    sizes, stack = size.tolist(), []
    for i, is_gap in enumerate(gap.tolist()):
        if not is_gap:
            stack.append(i)
            continue
        free = sizes[i]
        while stack and sizes[stack[-1]] <= free:
            j = stack.pop()
            role[j], of[j], offset[j] = PLACED, i, whole - free
            free -= sizes[j]
            role[i] = SHRUNK
        offset[i] = free
    return role, of, offset


def across(parts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which gaps meet which pieces of lower partitions: (gap partition, first gap, piece partition, end of pieces, number of pieces, pieces for a gap).

    parts: (partition, gaps, pieces, smallest gap, largest piece), ascending. Gaps are taken in order, pieces from the largest
    down; a gap takes as many as surely fit.
    """
    waiting, out = [], []
    for p, gaps, n, least, most in parts:
        i = 0
        while i < gaps and waiting:
            q, left, largest = waiting.pop()
            each = max(1, least // largest)
            take = min((gaps - i) * each, left)
            out.append((p, i, q, left, take, each))
            i += -(-take // each)
            if take < left:
                waiting.append((q, left - take, largest))
        if n:
            waiting.append((p, n, most))
    return out


def _swept(state: DataFrame, rows: int, whole: int) -> DataFrame:
    """state with role, of (a sequence), offset, part and rank in what is left of its partition, each partition swept by itself."""
    def run(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        size, gap = t.column("size").to_numpy(), ~np.asarray(t.column("sequence_id").is_null().combine_chunks())
        role, of, offset = sweep(size, gap, whole)
        rank = np.zeros(len(role), np.int64)
        for r in (GAP, WAITING):
            rank[role == r] = np.arange((role == r).sum())
        sequence = t.column("sequence_id").combine_chunks().take(pa.array(np.where(of >= 0, of, np.arange(len(of)))))
        columns = [sequence if c == "sequence_id" else t.column(c).combine_chunks() for c in t.column_names]
        more = [pa.array(role.astype(np.int32)), pa.array(offset), pa.array(np.full(len(role), TaskContext.get().partitionId(), np.int32)), pa.array(rank)]
        yield pa.RecordBatch.from_arrays([*columns, *more], [*t.column_names, "role", "offset", "part", "rank"])

    dealt = state.repartitionByRange(max(1, -(-rows // SWEPT_ROWS)), "size", F.col("sequence_id").isNotNull(), "tie").sortWithinPartitions("size", F.col("sequence_id").isNotNull(), "tie")
    return dealt.mapInArrow(thrifty(run), SWEPT)


def _met(left: DataFrame, meets: list) -> DataFrame:
    """Rows left in the partitions with (meet, turn, slot); a meet of -1: they meet nothing."""
    spark = left.sparkSession
    by = spark.sparkContext.broadcast({
        True: {p: [(k, m) for k, m in enumerate(meets) if m[0] == p] for p in {m[0] for m in meets}},
        False: {q: [(k, m) for k, m in enumerate(meets) if m[2] == q] for q in {m[2] for m in meets}}})

    def run(batches):
        for b in batches:
            part, rank, gap = b.column("part").to_numpy(), b.column("rank").to_numpy(), b.column("role").to_numpy() == GAP
            meet, turn, slot = np.full(len(part), -1), np.zeros(len(part), np.int64), np.full(len(part), -1)
            for p in np.unique(part):
                for k, (_, first, _, end, n, each) in by.value[True].get(int(p), ()):
                    m = gap & (part == p) & (rank >= first) & (rank < first + -(-n // each))
                    meet[m], turn[m] = k, rank[m] - first
                for k, (_, _, _, end, n, each) in by.value[False].get(int(p), ()):
                    m = ~gap & (part == p) & (rank < end) & (rank >= end - n)
                    meet[m], turn[m], slot[m] = k, (end - 1 - rank[m]) // each, (end - 1 - rank[m]) % each
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(meet), pa.array(turn), pa.array(slot)], [*b.schema.names, "meet", "turn", "slot"])

    return left.mapInArrow(thrifty(run), SWEPT + ", meet long, turn long, slot long")


OUT = ["doc_id", "piece", "start", "size", "ids_crc32", "sequence_id", "offset"]


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of pieces of at most `size`."""
    columns = [c.split()[0] for c in STATE.split(", ")]
    state = pieces.select("doc_id", "piece", "start", F.col("length").alias("size"), "ids_crc32", F.lit(None).cast("long").alias("sequence_id"), F.xxhash64(F.monotonically_increasing_id(), "ids_crc32").alias("tie"))
    state, done, step = written(state, "pieces"), [], 0
    waiting = state
    gaps = None
    rows = None
    while True:
        # Largest first, as many as the rest fills at least.
        counts = sorted(((r["size"], r["count"]) for r in waiting.groupBy("size").count().collect()), reverse=True)  # at most `size` rows
        if not counts:
            break
        rows = sum(n for _, n in counts) if rows is None else rows
        need = max(-(-sum(s * n for s, n in counts) // size), sum(n for s, n in counts if 2 * s > size))
        opens = F.lit(False)
        for s, n in counts:
            if n > need:
                run = F.col("size") == s
                if need <= FEW_OPENED:
                    last = waiting.filter(run).select("tie").orderBy("tie").limit(need).agg(F.max("tie")).head()[0]
                    opens |= run & (F.col("tie") <= F.lit(last)) & F.lit(need > 0)
                else:  # a random part of the run, rather a little less than a little more
                    opens |= run & (F.pmod(F.xxhash64("tie", F.lit(step)), F.lit(1 << 30)) < int((need - 2 * need**0.5) / n * (1 << 30)))
                break
            need, opens = need - n, F.col("size") >= s
        marked = written(waiting.withColumn("opens", opens).withColumn("new", F.monotonically_increasing_id() + F.lit(step << 56)), "opened")
        opened = marked.filter("opens").withColumn("sequence_id", F.col("new")).withColumn("offset", F.lit(0).cast("long"))
        done.append(opened.select(*OUT))
        fresh = opened.filter(F.col("size") < size).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("long").alias("start"), (size - F.col("size")).alias("size"), F.lit(None).cast("long").alias("ids_crc32"), "sequence_id", "tie")
        gaps = fresh if gaps is None else gaps.unionByName(fresh)
        waiting = marked.filter("NOT opens").select(*columns)
        step += 1
        while True:
            swept = written(_swept(waiting.unionByName(gaps), rows, size), "swept")
            parts = swept.groupBy("part").agg(
                F.count_if(F.col("role") == GAP).alias("gaps"), F.count_if(F.col("role") == WAITING).alias("n"), F.min(F.when(F.col("role") == GAP, F.col("size"))).alias("least"),
                F.max(F.when(F.col("role") == WAITING, F.col("size"))).alias("most"), F.count_if(F.col("role") == PLACED).alias("placed")).collect()
            meets = across([(r["part"], r["gaps"], r["n"], r["least"], r["most"]) for r in sorted(parts)])
            done.append(swept.filter(F.col("role") == PLACED).select(*OUT))
            gaps = swept.filter(F.col("role") == SHRUNK).filter("offset > 0").withColumn("size", F.col("offset")).select(*columns)
            left, placed = swept.filter(F.col("role") >= GAP), sum(r["placed"] for r in parts) + sum(m[4] for m in meets)
            if meets:
                w = Window.partitionBy("meet", "turn").orderBy("slot")
                met = _met(left, meets)
                pairs = met.filter("meet >= 0").withColumn("first", F.first("size").over(w)).withColumn("sequence_id", F.first("sequence_id").over(w))
                pairs = pairs.withColumn("used", F.sum(F.expr("if(slot >= 0, size, 0)")).over(w)).withColumn("last", F.lead("slot").over(w).isNull())
                met = written(pairs.unionByName(met.filter("meet < 0"), allowMissingColumns=True), "met")
                done.append(met.filter("slot >= 0").withColumn("offset", size - F.col("first") + F.col("used") - F.col("size")).select(*OUT))
                shrunk = met.filter("last AND first > used").withColumn("size", F.col("first") - F.col("used"))
                empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("piece", "int"), ("start", "long"))]
                gaps = gaps.unionByName(shrunk.select(*empty, "size", F.lit(None).cast("long").alias("ids_crc32"), "sequence_id", "tie"))
                left = met.filter("meet < 0")
            gaps = gaps.unionByName(left.filter(F.col("role") == GAP).select(*columns))
            waiting = left.filter(F.col("role") == WAITING).select(*columns)
            still = sum(r["n"] for r in parts) - sum(m[4] for m in meets)
            if not still or not placed:
                break
        if not still:
            break
    whole = None
    for part in done:
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    return whole.withColumnRenamed("size", "length")


CONTRACT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())).select(*CONTRACT)
