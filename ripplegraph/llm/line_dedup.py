"""Line dedup: exact copies, and near lines, across all documents.

Near lines are within edit_limit() edits of each other: PERCENT % of the longer one's characters, EDITS at least. Two
searches find candidates.

The first misses no pair within EDITS edits. A line has EDITS + 1 segments, whose width follows from its length, rounded
down so that lines of nearly the same length have the same one. EDITS edits leave one of them whole, and for some whole
segment there are no more edits on either side of it than there are segments, so that in the other line it stands in
almost the same place, counted from the nearer end. Signatures of segments and of the probed places meet in a join; a
sketch of the line's character pairs, of which each edit changes four bits at most, thins out the candidates. Where many
lines have a signature in common, what the segment leaves of the lines must itself be within EDITS edits, so it is cut
and probed once more: lines of one pattern meet only by what tells them apart.

The second is for lines long enough for more edits. It deals a line's substrings of GRAM characters, the length of a
segment when a line is cut into one more than its edits, to GRAMS bins by their hashes and takes the least hash of each;
lines meet that share one of these at nearly the same place. A pair that shares J of its substrings meets with a
probability of about 1 - (1 - J) ** GRAMS, so pairs whose many edits are spread evenly over the line may be missed.

Where FEW lines meet in the second search, all are compared; where more do, or where CROWD lines are alike in two segments
of the first, all are compared with FEW of them, which makes one class of most of a large group of near lines. Groups that
hold lines of several classes then go to Python in blocks, and every two lines of different classes are compared there:
lengths and counts of character pairs, which an edit changes by four at most, leave few texts to look at.

Most signatures stand in one line only. One pass over the shuffled signatures, which sorts a task's in arrays, finds those
that two different lines have, and only these go on. The edit distance of the texts decides. A line is known by a hash of 128 bits;
copies of a line are one line in all of this.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut_lineage
from .decontaminate import Powers
from .rows import as_bytes, free_name, slices, tidied

EDITS, PERCENT, MIN_CHARS = 2, 5, 30
GRAM, GRAMS = 100 // PERCENT, 6
#: Low bits of a packed hash that hold the place in the line.
PLACE_BITS = 20
#: Bytes of lines that are worked on at once: their characters' hashes, some dozen arrays of 8 bytes a character, stay small.
SLICE = 1 << 18
#: Hashes of lines that a task remembers, so as to send a line once.
SENT = 1 << 18
#: Rows of shared and other keys that a task holds before it sends those that are known to be shared.
HELD = 1 << 20
#: Bits of the filter that names the lines whose texts a later pass must fetch.
FILTER_BITS = 23
#: Lines with a signature in common that are paired as they are.
CROWD = 64
#: Lines that meet by a substring and are all compared at once; of more, so many that the others are compared with first.
FEW = 8
#: Lines, and characters, of a larger group that are compared with as many others in one call.
BLOCK, BLOCK_CHARS = 2048, 1 << 22
#: Words of 64 diagonals in which many pairs are compared at once, and fewer pairs than are worth it.
WORDS, FEW_AT_ONCE = 6, 24
#: Pairs of large groups that wait for each other, so that calls are large, and pairs of a call.
AT_ONCE, CALL = 1 << 16, 4096
#: Kinds of character pairs that are counted.
KINDS = 64
#: Pairs whose hashes, 16 bytes a pair, are sent to where the texts are.
FEW_PAIRS = 1 << 16

_U = np.uint64
_MIX = _U(0xFF51AFD7ED558CCD)


def line_hash(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def _first_halves(hashes: list[bytes]) -> np.ndarray:
    """The first 64 bits of each hash, by which candidates go."""
    return np.frombuffer(b"".join(hashes), ">i8")[::2].astype(np.int64)


def edit_limit(length: int, edits: int = EDITS, percent: int = PERCENT) -> int:
    """Edits that make near lines of two, the longer one of this length."""
    return max(edits, length * percent // 100)


def probes(edits: int) -> list[tuple[int, int]]:
    """(segment, shift): where to look for the segments of a line that is `edits` edits away. The first edits + 1 are the
    segments themselves. Segments of the first half count from the line's start, the others from its end."""
    reach = [min(i, edits - i) for i in range(edits + 1)]
    return [(i, 0) for i in range(edits + 1)] + [(i, s) for i, r in enumerate(reach) for s in range(-r, r + 1) if s]


def rounded(length: np.ndarray, edits: int) -> np.ndarray:
    """Lengths with all but their four highest bits cleared, and the bits below a power of two that the edits do not exceed:
    lengths that differ by the edits have at most two different ones."""
    low = np.maximum(np.frexp(np.maximum(length, 1).astype(float))[1] - 4, (edits - 1).bit_length())
    return length >> low << low


class Lines:
    """Lines that are long enough: their characters, segment signatures, substrings and sketches."""

    def __init__(self, lines: list[bytes], hashes: np.ndarray, edits: int = EDITS, min_chars: int = MIN_CHARS):
        chars = np.frombuffer(b"\n".join([*lines, b""]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(chars == 10)[: len(lines)]
        starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)[: len(lines)]
        self.kept = np.flatnonzero(ends - starts >= min_chars)
        self.starts, self.length, self.hash, self.chars = starts[self.kept], (ends - starts)[self.kept], hashes[self.kept], chars
        self.edits = edits
        n = len(chars) + 1
        self.up, self.down = Powers.get(n)
        self.total = np.zeros(n, np.uint64)  # of the characters' products with powers, from which a substring's hash follows
        np.cumsum((chars.astype(np.uint64) + _U(1)) * self.up[: n - 1], out=self.total[1:])

    def signatures(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, number, signature) of each of probes() for each line, by the line's own rounded length and, where it
        differs, by that of a line longer by the edits; the latter's numbers begin after the former's."""
        parts, count, total, down = self.edits + 1, len(probes(self.edits)), self.total, self.down
        out, every = [], np.arange(len(self.length))
        longer = np.flatnonzero(rounded(self.length, self.edits) != rounded(self.length + self.edits, self.edits))
        for number in range(2 * count):
            at = longer if number >= count else every
            a, width, base = self.places(number, at)
            there = (width > 0) & (a >= self.starts[at]) & (a + width <= self.starts[at] + self.length[at])
            if not there.all():
                at, a, width, base = at[there], a[there], width[there], base[there]
            h = (total[a + width] - total[a]) * down[a]
            h = (h ^ (h >> _U(31))) * _MIX + base.astype(np.uint64) * _U(parts) + _U(probes(self.edits)[number % count][0])
            h = (h ^ (h >> _U(29))) * _MIX
            out.append((at, np.full(len(at), number), h ^ (h >> _U(32))))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def places(self, number: int, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and width, in chars, of a numbered probe of each line, and the rounded length that they follow from."""
        longer, probe = divmod(number, len(probes(self.edits)))
        i, shift = probes(self.edits)[probe]
        starts, length = self.starts[at], self.length[at]
        base = rounded(length + longer * self.edits, self.edits)
        width = base // (self.edits + 1)
        if 2 * i <= self.edits:
            return starts + i * width + shift, width, base
        return starts + length - (self.edits - i + 1) * width + shift, width, base

    def least_grams(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The lines that may differ by more than EDITS edits, and a row for each: the least hash in each of GRAMS bins of
        its substrings of GRAM characters, with the substring's place in the low PLACE_BITS; all ones for an empty bin."""
        at = np.flatnonzero((self.length * percent // 100 > self.edits) & (self.length >= GRAM))
        if not len(at):
            return at, np.zeros((0, GRAMS), np.uint64)
        h = (self.total[GRAM:] - self.total[:-GRAM]) * self.down[: len(self.total) - GRAM]
        h = (h ^ (h >> _U(31))) * _MIX
        low = _U((1 << PLACE_BITS) - 1)
        place = np.arange(len(h), dtype=np.uint64)
        base = np.zeros(len(at), np.uint64)  # of each line: what is yet to be taken from the places
        if len(h) <= int(low):
            base = self.starts[at].astype(np.uint64)
        else:
            start = np.zeros(len(h), np.uint64)
            start[self.starts[at]] = self.starts[at]
            place = np.minimum(place - np.maximum.accumulate(start), low)
        spans = np.stack((self.starts[at], self.starts[at] + self.length[at] - GRAM + 1), axis=1).ravel()
        h = (h ^ (h >> _U(29))) & ~low | place
        # a bin is a range of hashes; once its lower end is taken from all, those below it are the largest
        out, step = np.empty((len(at), GRAMS), np.uint64), _U((1 << 64) // GRAMS) & ~low
        for k in range(GRAMS):
            least = np.minimum.reduceat(h, spans)[::2]
            out[:, k] = np.where(least < step, least + _U(k) * step - base, ~_U(0))
            h -= step
        return at, out

    def sketches(self) -> np.ndarray:
        """32 bits for each line: whether the pairs of neighbouring characters that fall to a bit are odd in number."""
        if not len(self.length):
            return np.zeros(0, np.int32)
        pair = (self.chars[:-1] * np.uint32(0x9E3779B1)) ^ (self.chars[1:] * np.uint32(0x85EBCA77))
        bits = np.uint32(1) << ((pair * np.uint32(0xC2B2AE3D)) >> np.uint32(27))
        spans = np.stack((self.starts, self.starts + self.length - 1), axis=1).ravel()
        return np.bitwise_xor.reduceat(np.append(bits, np.uint32(0)), spans)[::2].view(np.int32)


def edit_distance_within(a: str, b: str, edits: int) -> bool:
    """Whether a becomes b by at most `edits` insertions, deletions and substitutions.

    Bit-parallel: a word of 2 * edits + 1 bits holds the diagonals of the band; bit d of level e says that with e edits
    the characters up to the current one of a match those of b up to the one that lies d - edits further.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    band = (1 << (2 * edits + 1)) - 1
    where: dict[str, int] = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << k
    at = 1 << edits  # nothing of either is read
    level = [at]
    for _ in range(edits):
        level.append(level[-1] | level[-1] << 1 & band)
    for k, c in enumerate(a):
        same = where.get(c, 0)
        same = same >> (k - edits) & band if k >= edits else same << (edits - k) & band
        last, new = level, []
        for e in range(edits + 1):
            row = last[e] & same
            if e:  # a substitution keeps the diagonal, a deletion from a moves one back, an insertion one on
                row |= last[e - 1] | last[e - 1] >> 1 | new[e - 1] << 1
            new.append(row & band)
        level = new
        if not level[-1]:
            return False
    return bool(level[edits] >> (len(b) - len(a) + edits) & 1)


def _common(a: str, b: str, i: int, j: int) -> int:
    """How many characters from a[i] and b[j] on are the same."""
    most, step = min(len(a) - i, len(b) - j), 32
    n = 0
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = n + step, 2 * step
    end = min(n + step, most)
    n = min(n, most)
    while n < end:  # the first difference lies before end
        half = (n + end + 1) // 2
        if a[i + n : i + half] == b[j + n : j + half]:
            n = half
        else:
            end = half - 1
    return n


def _some_edits(a: str, b: str, edits: int) -> int | None:
    """The number of some edits that make b of a, if a quick search finds as few as asked for."""
    i, j, done = 0, 0, 0
    while True:
        n = _common(a, b, i, j)
        i, j = i + n, j + n
        left = edits - done
        if max(len(a) - i, len(b) - j) <= left:
            return done + max(len(a) - i, len(b) - j)
        for skip in range(left + 1):  # where the texts go on alike
            word = a[i + skip : i + skip + 8]
            if len(word) < 8:
                return None
            k = b.find(word, j, j + left + 8)
            if k >= 0:
                break
        else:
            return None
        i, j, done = i + skip, k, done + max(skip, k - j)


def few_edits(a: str, b: str, edits: int, look: bool = True) -> bool:
    """As edit_distance_within(), for any number of edits. With look a quick search may find few enough; if not, the columns of
    near_pairs() decide, in whole numbers as wide as the band. Along the diagonal that ends in both texts' last characters
    the distance never falls, so that unlike texts end soon."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) - len(b) > edits:
        return False
    if a == b or look and _some_edits(a, b, edits) is not None:
        return True
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    band = (1 << (2 * edits + 1)) - 1
    up, down, score = band & ~((1 << edits) - 1), 0, len(a) - len(b)
    end = score + edits
    for j, c in enumerate(b):
        same = where.get(c, 0)
        same = (same >> (j - edits) if j >= edits else same << (edits - j)) & band
        kept = (((same & up) + up) ^ up) & band | same | down
        more, less = down | band & ~(kept | up), kept & up
        if not kept >> end & 1:
            score += 1
            if score > edits:
                return False
        kept >>= 1
        up, down = less | band & ~(kept | more), kept & more
    return True


def _line_rows(min_chars: int, short_copies: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, number, hashes = [], [], []
            for d, text in enumerate(as_bytes(batch.column(1))):
                for k, line in enumerate(text.split(b"\n") if text else ()):
                    long = len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "replace")) >= min_chars)
                    if long or short_copies and line and not line.isspace():
                        row.append(d)
                        number.append(k)
                        hashes.append(line_hash(line))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(number, pa.int32()), pa.array(hashes, pa.binary())], names=["doc_id", "text_key", "line", "node"])

    return kernel


def _fresh(batches: Iterator[pa.RecordBatch], column: int, min_bytes: int, wanted=None) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Lines of min_bytes or more, and their hashes, some MB at a time; most of them once a task."""
    sent: set[bytes] = set()
    lines, hashes, size = [], [], 0
    for batch in slices(batches, column, SLICE):
        for text in as_bytes(batch.column(column)):
            for line in text.split(b"\n") if text else ():
                if len(line) >= min_bytes and (h := line_hash(line)) not in sent and (wanted is None or wanted(h)):
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(h)
                    lines.append(line)
                    hashes.append(h)
                    size += len(line)
                    if size >= SLICE:
                        yield lines, hashes
                        lines, hashes, size = [], [], 0
    if lines:
        yield lines, hashes


def _rows(sig: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (sig, place, hashes)], names=["sig", "place", "hash"])


ROWS = "sig bigint, place bigint, hash bigint"


def _segment_places(sketch: np.ndarray, number: np.ndarray, edits: int) -> np.ndarray:
    """A line's sketch, the number of the probe, and in the lowest bit whether it is one of the line's own segments."""
    return sketch.astype(np.int64) << 16 | number << 1 | (number % len(probes(edits)) <= edits)


def _key_rows(edits: int, min_chars: int, percent: int):
    """A row for each probe of each line, of even sig; place: see _segment_places(). With percent a row for each least hash
    of each line that may have more edits, of odd sig; place: where it stands, and the line's length."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, hashes in _fresh(batches, 0, min_chars):
            lines = Lines(found, _first_halves(hashes), edits, min_chars)
            at, number, sigs = lines.signatures()
            yield _rows((sigs & ~_U(1)).view(np.int64), _segment_places(lines.sketches()[at], number, edits), lines.hash[at])
            if percent:
                at, least = lines.least_grams(percent)
                place = (least & _U((1 << PLACE_BITS) - 1)) << _U(32) | lines.length[at].astype(np.uint64)[:, None]
                full = (least != ~_U(0)).ravel()
                sigs = (least >> _U(PLACE_BITS) << _U(1) | _U(1)).ravel()[full]
                yield _rows(sigs.view(np.int64), place.ravel()[full].view(np.int64), np.repeat(lines.hash[at], GRAMS)[full])

    return kernel


def _several(table: pa.Table, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the rows of which different lines have the sig, of the others, and of one row for each sig of the former.
    sent: rows that stand for a sig whose rows so far are among those of an earlier call."""
    sig, line = table.column(0).to_numpy(), table.column(2).to_numpy()
    order = np.argsort(sig)
    sig, line, sent = sig[order], line[order], sent[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    several = (np.minimum.reduceat(line, first) != np.maximum.reduceat(line, first)) | np.logical_or.reduceat(sent, first)
    there = np.repeat(several, np.diff(np.append(first, len(sig))))
    return order[there & ~sent], order[~there], order[first[several]]


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sig, place, hash and more whose sig another hash has too, of which all rows come. Rows of a sig that is
    shared are sent at once and one of them stays, so that a sig of many lines takes no memory."""
    held, size, most = [], 0, HELD
    sent = np.zeros(0, bool)

    def part() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, sent
        table = pa.Table.from_batches(held)
        go, others, known = _several(table, np.append(sent, np.zeros(size - len(sent), bool)))
        yield from table.take(pa.array(go)).combine_chunks().to_batches()
        held = table.take(pa.array(np.append(known, others))).combine_chunks().to_batches()
        size, sent = len(known) + len(others), np.arange(len(known) + len(others)) < len(known)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= most:
            yield from part()
            most = max(HELD, 2 * size)
    if size:
        yield from part()


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose sig another line has too, each once, with the number of rows that have it."""
    # the few rows that are left are made distinct, not all of them
    kept = cut_lineage(rows.repartition("sig").mapInArrow(tidied(_shared_rows), rows.schema).distinct())
    return kept.join(kept.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig")


def _met(rows: DataFrame, edits: int) -> DataFrame:
    """(a, b) of different lines that share a signature, one of them as a segment, and whose sketches are near enough."""
    test = f"""x.sig = y.sig AND x.hash <> y.hash AND ((y.place & 1) = 0 OR x.hash < y.hash)
        AND bit_count((shiftright(x.place, 16) ^ shiftright(y.place, 16)) & 4294967295L) <= {4 * edits}"""
    pairs = rows.where("(place & 1) = 1").alias("x").join(rows.alias("y"), F.expr(test))
    return pairs.select(F.least("x.hash", "y.hash").alias("a"), F.greatest("x.hash", "y.hash").alias("b"))


def _rest_rows(edits: int):
    """Of (hash, sigs, places, text): what each probe leaves of the text, cut and probed in its turn, and its length."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE >> 2):
            texts, hashes = batch.column(3).to_pylist(), batch.column(0).to_numpy()
            lines = Lines([t.encode() for t in texts], hashes, edits, 0)
            where = [lines.places(k) for k in range(2 * len(probes(edits)))]
            rests, owner, above, sketch = [], [], [], []
            for d, (sigs, places) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for sig, place in zip(sigs, places, strict=True):
                    start, width, _ = where[(place & 0xFFFF) >> 1]
                    a = int(start[d] - lines.starts[d])
                    rests.append(texts[d][:a] + texts[d][a + int(width[d]) :])
                    owner.append(d)
                    above.append(sig)
                    sketch.append(place >> 16)
            if rests:
                rest = Lines([t.encode() for t in rests], hashes[owner], edits, 0)
                at, number, sigs = rest.signatures()
                up = np.array(above, np.int64).view(np.uint64)[at]
                sigs = (sigs ^ (up >> _U(17))) * _MIX + up
                place = _segment_places(np.array(sketch, np.int64)[at], number, edits)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(place), pa.array(rest.hash[at]), pa.array(rest.length[at])], names=["sig", "place", "hash", "length"])

    return kernel


def _shared_keys(docs: DataFrame, text_col: str, edits: int, min_chars: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What different lines share: the rows of segments and those of substrings, which one pass makes and one shuffle deals."""
    rows = _shared(docs.select(F.col(text_col)).mapInArrow(tidied(_key_rows(edits, min_chars, percent)), ROWS))
    return rows.where("(sig & 1) = 0"), rows.where("(sig & 1) = 1")


def _near_candidates(docs: DataFrame, text_col: str, edits: int, min_chars: int, rows: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines by the first halves of their hashes: (a, b) of different ones that may be within `edits` edits, some rows
    repeat; and (meet, hash, length, at), lines of which many are alike in two segments. rows: of the shared segments; texts: of
    their lines, see _texts()."""
    rows = _shared_keys(docs, text_col, edits, min_chars, 0)[0] if rows is None else rows
    pairs = cut_lineage(_met(rows.where(f"n <= {CROWD}"), edits).distinct())
    crowded = rows.where(f"n > {CROWD}")
    asked = crowded.select("hash").distinct()
    texts = _texts(docs, text_col, asked, min_chars) if texts is None else texts.join(asked, "hash", "left_semi")
    texts = texts.groupBy("hash").agg(F.collect_set("text").alias("texts"))
    per_line = crowded.groupBy("hash").agg(F.collect_list("sig").alias("sigs"), F.collect_list("place").alias("places"))  # as many as probes
    rests = per_line.join(texts, "hash").select("hash", "sigs", "places", F.explode("texts").alias("text"))
    rows = _shared(rests.mapInArrow(tidied(_rest_rows(edits)), f"{ROWS}, length bigint"))
    groups = rows.where(f"n > {CROWD}").select(F.col("sig").alias("meet"), "hash", "length", F.lit(0).cast("bigint").alias("at")).distinct()
    return pairs.unionByName(_met(rows.where(f"n <= {CROWD}"), edits)), groups


def _gram_groups(rows: DataFrame, edits: int, percent: int) -> DataFrame:
    """(meet, hash, length, at): lines by the substrings that others have too, from the rows of these.

    Lines meet by the substring and by a cell of length and place, so that a passage that many lines share brings together
    only lines that are alike in both. Cells are four times as wide as near lines may differ; a line stands in each cell
    that a longer line near it may be in.
    """
    rows = rows.select("sig", "hash", F.expr("place & 4294967295L").alias("length"), F.shiftright("place", 32).alias("at"))
    step = 1.001 * 100 / (100 - percent)
    size = lambda n: F.floor(F.log(n) / F.log(F.lit(step)) / 4)
    rows = rows.withColumn("size", F.explode(F.array_distinct(F.array(size(F.col("length")), size(F.col("length") * step)))))
    reach = f"(ceil(pow({step}D, 4 * size + 4) * {percent / 100}D) + {edits})"
    rows = rows.withColumn("cell", F.explode(F.expr(f"sequence(floor((at - {reach}) / (4 * {reach})), floor((at + {reach}) / (4 * {reach})))")))
    return rows.select(F.xxhash64("sig", "size", "cell").alias("meet"), "hash", "length", "at")


def _near_test(x: str, y: str, edits: int, percent: int) -> str:
    limit = f"greatest({edits}, greatest({x}.length, {y}.length) * {percent} DIV 100)"
    return f"{x}.hash <> {y}.hash AND abs({x}.length - {y}.length) <= {limit} AND abs({x}.at - {y}.at) <= {limit}"


def _linked(pairs: DataFrame, texts: DataFrame, edits: int, percent: int) -> DataFrame:
    """(a, b, src, dst) of the pairs(a, b) that are near: first halves and whole hashes of the lines."""
    if pairs.count() <= FEW_PAIRS:  # then only their texts are shuffled
        texts = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("hash")).distinct()), "hash", "left_semi")
    one, other = (texts.select(F.col("hash").alias(h), F.col("node").alias(n), F.col("text").alias(t)) for h, n, t in (("a", "u", "x"), ("b", "v", "y")))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "u", "v", "x", "y")
    return cut_lineage(both.mapInArrow(tidied(_verified(edits, percent)), "a bigint, b bigint, src binary, dst binary"))


def _near_classes(near: DataFrame, groups: DataFrame, texts: DataFrame, edits: int, percent: int) -> DataFrame:
    """(node, component) of the near lines among the pairs near(a, b) and those of the groups, by their whole hashes."""
    sizes = groups.groupBy("meet").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars")).where("n > 1")
    members = cut_lineage(groups.join(sizes, "meet"))
    # drawn by a hash of the line, so that groups with the same lines compare the same pairs
    asked = members.where(F.expr(f"pmod(xxhash64(hash, 0), 1 << 30) < {FEW << 30}L / n"))
    met = asked.alias("x").join(members.alias("y"), F.expr(f"x.meet = y.meet AND {_near_test('x', 'y', edits, percent)}"))
    pairs = met.select(F.least("x.hash", "y.hash").alias("a"), F.greatest("x.hash", "y.hash").alias("b")).unionByName(near)
    found = connected_components(_linked(cut_lineage(pairs.distinct()), texts, edits, percent).select("src", "dst"))
    large = members.where(f"n > {FEW}")
    if large.isEmpty():
        return found
    found = cut_lineage(found)
    nodes = large.join(texts.select("hash", "node"), "hash").join(found, "node", "left")
    nodes = nodes.select("meet", "node", "length", "n", "chars", F.coalesce("component", "node").alias("class"))
    several = nodes.groupBy("meet").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("meet")
    rest = nodes.join(several, "meet")
    meets = rest.groupBy("node").agg(F.collect_set("meet").alias("meets"))  # as many as signatures
    rest = cut_lineage(rest.join(meets, "node").withColumn("before", F.expr("filter(meets, x -> x < meet)")).drop("meets"))
    more = cut_lineage(_links_between(rest, texts, edits, percent))
    if more.isEmpty():
        return found
    # a class is named by its least line, so that the classes' components are named by theirs
    joined = cut_lineage(connected_components(more).select(F.col("node").alias("class"), F.col("component").alias("least")))
    wider = found.join(joined, F.col("component") == F.col("class"), "left").select("node", F.coalesce("least", "component").alias("component"))
    alone = joined.join(found, F.col("class") == F.col("node"), "left_anti").select(F.col("class").alias("node"), F.col("least").alias("component"))
    return wider.unionByName(alone)


def _links_between(members: DataFrame, texts: DataFrame, edits: int, percent: int) -> DataFrame:
    """(src, dst) classes between which there are links, within each group of members(meet, node, length, n, chars, class, before).

    Lines that meet in several groups are compared in the first of these, before holds a line's groups up to there. A group is cut into blocks by a hash of its lines, and any two blocks, or one alone, are a call; lines are sent as often
    as there are blocks.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    dealt = dealt.join(texts.select("node", "text"), "node").select("meet", "one", "two", "own", "node", "class", "length", "before", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 3):
            column = {n: table.column(n) for n in table.column_names}
            first = _first_rows(table, 3)
            _, label = np.unique(np.array(column["class"].to_pylist(), object), return_inverse=True)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
            _, label = np.unique(group * (label.max() + 1) + label, return_inverse=True)
            own, length = column["own"].to_numpy(), column["length"].to_numpy()
            a, b = links_between(column["text"].to_pylist(), label, length, column["before"].to_pylist(), own, edits, percent, first)
            name = column["class"].combine_chunks()
            yield pa.RecordBatch.from_arrays([name.take(pa.array(x, pa.int64())) for x in (a, b)], names=["src", "dst"])

    keys = ("meet", "one", "two")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(kernel), "src binary, dst binary")


def _first_rows(table: pa.Table, keys: int) -> np.ndarray:
    """Where the rows of each group begin, known by the first columns."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        key = table.column(k).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first columns, some MB at a time, so that rows of one group come together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_CHARS:
            table = pa.Table.from_batches(held)
            last = int(_first_rows(table, keys)[-1]) if table.num_rows else 0
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
            size = sum(x.nbytes for x in held)
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each of KINDS kinds of character pairs stands in each text; the counts of two texts differ by four for
    each edit between them at most, in sum."""
    out, at = np.zeros((len(texts), KINDS), np.int16), 0
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + SLICE, "right")))
        chars = np.frombuffer("".join(texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        pair = (chars[:-1] * np.uint32(0x9E3779B1)) ^ (chars[1:] * np.uint32(0x85EBCA77))
        owner = np.repeat(np.arange(end - at), lengths[at:end])
        own = owner[:-1] == owner[1:]
        kind = owner[:-1] * KINDS + ((pair * np.uint32(0xC2B2AE3D)) >> np.uint32(26))
        counts = np.bincount(kind[own], minlength=(end - at) * KINDS).reshape(-1, KINDS)
        out[at:end] = np.minimum(counts, 0x7FFF >> 1)
        at = end
    return out


def links_between(texts: list[str], label: np.ndarray, length: np.ndarray, before: list[list[int]], block: np.ndarray, edits: int, percent: int, first: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Indices of near lines, enough to connect all classes, named by label, between which there are near lines. Where the
    lines are of two blocks, those of one block are not compared with each other; nor are those that have something in common in before.

    Several groups, whose first lines are given and whose labels differ, are compared at once, so that there are many pairs
    to a call; there are no links between them.
    """
    first = np.zeros(1, np.int64) if first is None else first
    label, limit, out, waiting = label.copy(), np.maximum(edits, length * percent // 100), ([], []), []

    def settle() -> None:
        """Compare what waits: of the pairs of two classes a few first, and more of them while no link is found."""
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        turn = 1
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            order = np.lexsort((hi, lo))
            first = np.flatnonzero(np.append(True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])))
            nth = np.empty(len(a), np.int64)
            nth[order] = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
            now = nth < turn
            x, y = a[now], b[now]
            linked = near([texts[k] for k in x], [texts[k] for k in y], edits, percent, False)
            for i, j in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    out[0].append(i)
                    out[1].append(j)
            a, b, turn = a[~now], b[~now], 4 * turn

    size = 0
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(texts)], strict=True):
        many = Counter(m for x in before[start:end] for m in x)
        bit = {m: k for k, (m, c) in enumerate(many.items()) if c > 1}
        met = np.zeros((end - start, len(many) // 8 + 1), np.uint8)
        for k, x in enumerate(before[start:end]):
            own = np.array([bit[m] for m in x if m in bit], np.int64)
            np.bitwise_or.at(met[k], own >> 3, (1 << (own & 7)).astype(np.uint8))
        counts, several = pair_counts(texts[start:end]), bool((block[start:end] != block[start]).any())
        for k in range(start, end - 1):
            most = np.maximum(limit[k], limit[k + 1 : end])
            some = (label[k + 1 : end] != label[k]) & (np.abs(length[k + 1 : end] - length[k]) <= most)
            if several:
                some &= block[k + 1 : end] != block[k]
            j = np.flatnonzero(some)
            if len(j):
                at = k - start
                j = j[np.abs(counts[at + 1 + j] - counts[at]).sum(axis=1, dtype=np.int64) <= 4 * most[j]]
                j = j[~(met[at + 1 + j] & met[at]).any(axis=1)]
                waiting.append((np.full(len(j), k), k + 1 + j))
                size += len(j)
                if size >= AT_ONCE:
                    settle()
                    size = 0
    if waiting:
        settle()
    return out


def _texts(docs: DataFrame, text_col: str, hashes: DataFrame, min_chars: int) -> DataFrame:
    """(hash, node, text) of the lines named by hashes(hash), the first halves of their hashes. A filter of fixed size
    tells which lines to send to the join."""
    bits = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    words = hashes.select(F.shiftright(bits, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    seen = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toArrow()  # as many words as the filter has, at most
    seen[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(seen.view(np.uint8), bitorder="little").tobytes())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, mask = shared.value, (1 << FILTER_BITS) - 1
        for lines, nodes in _fresh(batches, 0, min_chars, lambda h: there[int.from_bytes(h[:8], "big") & mask]):
            texts = pa.array([t.decode("utf-8", "replace") for t in lines], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(_first_halves(nodes)), pa.array(nodes, pa.binary()), texts], names=["hash", "node", "text"])

    found = docs.select(F.col(text_col)).mapInArrow(tidied(kernel), "hash bigint, node binary, text string")
    return found.join(hashes, "hash", "left_semi").groupBy("hash", "node").agg(F.any_value("text").alias("text"))


def near_pairs(longer: list[str], shorter: list[str], limits: np.ndarray) -> np.ndarray:
    """Whether each pair is within its limit of edits; the longer text of each comes first.

    Myers's bit-parallel columns in a band of diagonals, for all pairs at once: bit k, of as many words as the largest limit
    asks for, is the diagonal k - band, and a pair's distance grows along the diagonal that ends in its last characters.
    Pairs beyond their limit, and those at their end, are left out from time to time.
    """
    count, band = len(longer), int(limits.max())
    m, n = (np.fromiter(map(len, t), np.int64, count) for t in (longer, shorter))
    chars = np.frombuffer("".join([*longer, *shorter]).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(int(chars.max(initial=0)) + 1, bool)
    there[chars] = True
    kinds = np.cumsum(there)
    codes = kinds[chars].astype(np.uint8 if kinds[-1] < 256 else np.uint32)  # 0 stands for what lies outside a text
    words = -(-(2 * band + 1) // 64)
    width = 64 * words  # whole words, so that the comparisons of all pairs are packed as one row of bits
    a, b = np.zeros((count, band + int(m.max()) + width), codes.dtype), np.zeros((count, int(n.max())), codes.dtype)
    a[:, band : band + int(m.max())][np.arange(int(m.max())) < m[:, None]] = codes[: m.sum()]
    b[np.arange(b.shape[1]) < n[:, None]] = codes[m.sum() :]
    out, left, one, top = np.zeros(count, bool), np.arange(count), _U(1), _U(63)
    up, down = [np.full(count, _U((1 << 64 * words) - (1 << band) >> 64 * w & (1 << 64) - 1)) for w in range(words)], [np.zeros(count, np.uint64)] * words
    word, end = np.divmod(m - n + band, 64)
    end, score, shortest = end.astype(np.uint64), m - n, int(n.min())
    for j in range(b.shape[1]):
        if j % 32 == 0 and j:
            over = (score > limits) | (j >= n)
            if 8 * over.sum() >= len(left):
                out[left[over]] = (score <= limits)[over]
                go = ~over
                left, a, b, word, end, score, limits, n = left[go], a[go], b[go], word[go], end[go], score[go], limits[go], n[go]
                up, down = [x[go] for x in up], [x[go] for x in down]
                if not len(left):
                    return out
                shortest = int(n.min())
        every = np.packbits(a[:, j : j + width] == b[:, j : j + 1], bitorder="little").view(np.uint64).reshape(-1, words)
        kept, carry = [], None
        for w in range(words):
            same = every[:, w]
            added = same & up[w]
            added += up[w]
            if words > 1:
                more = added < up[w]
                if w:
                    added += carry
                    more |= added < carry
                carry = more.astype(np.uint64)
            added ^= up[w]
            added |= same
            added |= down[w]
            kept.append(added)
        ends = (kept[0] if words == 1 else np.choose(word, kept)) >> end
        ends &= one
        ends ^= one
        if j >= shortest:
            ends *= j < n
        score += ends.view(np.int64)
        for w in range(words):
            more = kept[w] | up[w]
            np.invert(more, out=more)
            more |= down[w]
            less = kept[w] & up[w]
            moved = kept[w] >> one
            if w + 1 < words:
                moved |= kept[w + 1] << top
            down[w] = moved & more
            moved |= more
            np.invert(moved, out=moved)
            moved |= less
            up[w] = moved
    out[left] = score <= limits
    return out


def near(x: list[str], y: list[str], edits: int, percent: int, look: bool = True) -> np.ndarray:
    """Whether each pair of lines is near; with look a quick search goes first where pairs are compared one by one, which
    pays where many are near."""
    longer, shorter = ([(s if (len(s) >= len(t)) == first else t) for s, t in zip(x, y, strict=True)] for first in (True, False))
    m, n = (np.fromiter(map(len, t), np.int64, len(x)) for t in (longer, shorter))
    limits = np.maximum(edits, m * percent // 100)
    some, out = m - n <= limits, np.zeros(len(x), bool)
    order = np.argsort(n, kind="stable")
    order = order[some[order]]
    words = 1 + (2 * limits[order] >> 6)
    words[words > WORDS] = 0
    for w in np.unique(words).tolist():
        own, at = order[words == w], 0
        while at < len(own):
            some = own[at : at + max(1, min(CALL, BLOCK_CHARS // int(n[own[min(at + CALL, len(own)) - 1]] + 1)))]
            at += len(some)
            if w and len(some) >= FEW_AT_ONCE:
                out[some] = near_pairs([longer[k] for k in some], [shorter[k] for k in some], limits[some])
            else:
                for k in some.tolist():
                    out[k] = few_edits(longer[k], shorter[k], int(limits[k]), look)
    return out


def _verified(edits: int, percent: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4, SLICE << 2):
            found = pa.array(near(*(batch.column(k).to_pylist() for k in (4, 5)), edits, percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(found) for k in range(4)], names=["a", "b", "src", "dst"])

    return kernel


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, percent: int = PERCENT, short_copies: bool = False) -> DataFrame:
    """(doc_id, text_key, line, class_id, drop): every line that has a copy or a near line, numbered from 0 in its text.

    Lines are what stands between two \\n; those of fewer than min_chars characters are left alone or, with short_copies,
    linked to their exact copies unless they are blank. Near lines are linked and a class is what links connect; class_id
    names the smallest hash in it. All of a class but its first line, in order of doc_id, text_key and line, is to be
    dropped. text_key, a hash of the whole text, tells apart different rows of one doc_id; rows with the same id and text
    are one document. Null texts have no lines, a null doc_id comes first; an empty table gives an empty result, and
    other columns are ignored. Spark jobs run while the result is being declared.
    """
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    keyed = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col))
    segments, grams = _shared_keys(docs, text_col, edits, min_chars, percent)
    # of all lines that share something, so that the documents are read once for texts
    texts = cut_lineage(_texts(docs, text_col, segments.select("hash").unionByName(grams.select("hash")).distinct(), min_chars))
    pairs, groups = _near_candidates(docs, text_col, edits, min_chars, segments, texts)
    groups = cut_lineage(groups.unionByName(_gram_groups(grams, edits, percent)) if percent else groups)
    near = _near_classes(pairs, groups, texts, edits, percent)
    lines = cut_lineage(keyed.mapInArrow(tidied(_line_rows(min_chars, short_copies)), f"doc_id {id_type}, text_key bigint, line int, node binary"))  # asked for twice
    counted = lines.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "line")).alias("first"))
    classes = counted.join(near, "node", "left").where("n > 1 OR component IS NOT NULL").select("node", F.coalesce("component", "node").alias("class"), "first")
    classes = cut_lineage(classes)
    named = classes.select("node", "class").join(classes.groupBy("class").agg(F.min("first").alias("first")), "class")
    found = lines.join(cut_lineage(named), "node")
    drop = ~F.struct("doc_id", "text_key", "line").eqNullSafe(F.col("first"))
    return found.select("doc_id", "text_key", "line", F.lower(F.hex("class")).alias("class_id"), drop.alias("drop"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, percent: int = PERCENT, short_copies: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_linked, n_dropped, dropped array<int>, classes array<string>) of every document.

    n_linked lines have a copy or a near line somewhere, classes are theirs; dropped are the numbers of the lines that
    clean_lines() would leave out. Null and empty texts have no lines. Repeated rows are repeated with the same report; two
    different texts of one id, a null id included, each have their own. An empty table gives an empty result, other columns
    are ignored; see repeated_lines().
    """
    found = repeated_lines(docs, id_col, text_col, edits, min_chars, percent, short_copies)
    lists = found.groupBy("doc_id", "text_key").agg(
        F.size(F.collect_set("line")).cast("bigint").alias("n_linked"),
        F.sort_array(F.collect_set(F.when(F.col("drop"), F.col("line")))).alias("dropped"),
        F.sort_array(F.collect_set("class_id")).alias("classes"),
    )
    n_lines = F.when(F.col(text_col).isNull() | (F.col(text_col) == ""), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    counts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), n_lines.cast("bigint").alias("n_lines"))
    out = counts.alias("c").join(lists.alias("l"), F.expr("c.doc_id <=> l.doc_id AND c.text_key = l.text_key"), "left")
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    dropped = F.coalesce("dropped", none("int"))
    return out.select("c.doc_id", "n_lines", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.size(dropped).cast("bigint").alias("n_dropped"), dropped.alias("dropped"), F.coalesce("classes", none("string")).alias("classes"))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, percent: int = PERCENT, short_copies: bool = False) -> DataFrame:
    """The documents, all of them and with all their columns, without the lines that are to be dropped.

    Null and empty texts stay as they are; a text of which every line goes becomes empty. Repeated rows stay and lose the
    same lines; different texts of one id, a null id included, lose each its own. Columns of any name are kept; an empty
    table gives an empty result. See repeated_lines().
    """
    found = repeated_lines(docs, id_col, text_col, edits, min_chars, percent, short_copies).where("drop")
    cut = free_name(docs, "cut")
    lists = found.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines")).select(F.struct("doc_id", "text_key", "lines").alias(cut))
    at = f"filter(split(`{text_col}`, '\\n', -1), (x, i) -> NOT array_contains(`{cut}`.lines, i))"
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.expr(f"array_join({at}, '\\n')"))
    joined = docs.join(lists, F.col(id_col).eqNullSafe(F.col(f"{cut}.doc_id")) & (F.xxhash64(text_col) == F.col(f"{cut}.text_key")), "left")
    return joined.withColumn(text_col, text).select(*docs.columns)
