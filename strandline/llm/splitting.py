"""Cutting oversized files at natural boundaries (problem 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.runtime import cut, table


@dataclass(frozen=True)
class Pieces:
    """most: bases a piece may have. overlap: bases in common between neighbours. range_bytes: bytes a worker looks at
    in one go. segment: bases whose boundaries one task holds; it has to be above `most` and changes no piece.
    """

    most: int = 4096
    overlap: int = 256
    range_bytes: int = 1 << 16
    segment: int = 1 << 20


KEYS = ["sequence_path", "text_key"]  # text_key tells apart different texts of one path
RANGES = "sequence_path string, text_key long, range_no long, opening long, rest long, last_state int, first_n int, last_n int, head_n int, marked int, cuts array<int>"


def file_ranges(files: DataFrame, how: Pieces) -> DataFrame:
    """Byte ranges (sequence_path, text_key, range_no, chunk) of every file; a null text has one empty range."""
    raw = files.where("sequence_path is not null").select("sequence_path", F.xxhash64("fasta").alias("text_key"), F.coalesce(F.col("fasta"), F.lit("")).cast("binary").alias("_raw"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("_raw") - 1, F.lit(0)).cast("long"), F.lit(how.range_bytes).cast("long"))
    exploded = raw.select(*KEYS, "_raw", F.posexplode(starts).alias("range_no", "_at"))
    return exploded.select(*KEYS, F.col("range_no").cast("long").alias("range_no"), F.expr(f"substring(_raw, cast(_at + 1 as int), {how.range_bytes})").alias("chunk"))


def stored_ranges(spark: SparkSession, folder: str, how: Pieces = Pieces()) -> DataFrame:
    """Byte ranges of the files of a folder, as file_ranges gives those of a table, with the file's address as its path.

    Only the listing is read first; every range is then read by itself at its offset, so a file may be larger than a
    worker's memory and than a string. An empty file has one empty range. Compressed files are not decompressed.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("sequence_path"), "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(how.range_bytes).cast("long"))
    ranges = listed.select("sequence_path", F.posexplode(starts).alias("range_no", "_at")).repartition("sequence_path", "range_no")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for pdf in batches:
            for path, no, at in zip(pdf["sequence_path"], pdf["range_no"], pdf["_at"]):
                if path not in held:
                    for f in held.values():
                        f.close()
                    where, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    held = {path: where.open_input_file(name)}
                yield pd.DataFrame({"sequence_path": [path], "text_key": [0], "range_no": [no], "chunk": [held[path].read_at(how.range_bytes, at)]})

    return ranges.mapInPandas(read, "sequence_path string, text_key long, range_no long, chunk binary")


def read_range(chunk: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """What one byte range tells without its neighbours.

    Its bytes up to the first line end may continue a header or bases of the range before; which is known only when
    the ranges are stitched. Returns the number of letters in that opening and after it, the state that the range
    leaves (1 in a header, 0 in a line of bases, -1 unchanged, 2 at a line start), the letters as an array, and for
    each letter whether a record begins at it and whether it is N.
    """
    raw = np.frombuffer(chunk, np.uint8)
    ends = (raw == 10) | (raw == 13)
    at = np.flatnonzero(ends)
    lower = raw | 32
    letter = (lower >= 97) & (lower <= 122)
    if not len(at):
        opening, state = int(letter.sum()), -1
        return opening, 0, state, raw[letter], np.zeros(opening, bool), lower[letter] == 110
    first = int(at[0]) + 1
    starts = at[at + 1 < len(raw)] + 1
    header = raw[starts] == 62
    flags = np.zeros(len(raw), bool)
    if len(starts):
        flags[starts[0] :] = np.repeat(header, np.diff(np.append(starts, len(raw))))
    state = 2 if ends[-1] else int(header[-1])
    opening = int(letter[:first].sum())
    keep = letter & ~flags
    begins = np.zeros(len(raw), bool)
    begins[starts[header]] = True
    # a record begins at the first kept letter after its header
    order = np.cumsum(keep) - keep
    record = np.zeros(int(keep.sum()) + 1, bool)
    record[order[np.flatnonzero(begins)]] = True
    return opening, int(keep[first:].sum()), state, raw[keep], record, lower[keep] == 110


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Boundary table of each range, relative to its own letters.

    cuts holds letters before which a record begins or a run of N has just ended. A cut at a record start is shown as
    -1 - place, as it holds even if the opening turns out to be a header.
    """
    for pdf in batches:
        out = []
        for path, key, no, chunk in zip(pdf["sequence_path"], pdf["text_key"], pdf["range_no"], pdf["chunk"]):
            chunk = bytes(chunk)
            opening, rest, state, _, record, is_n = read_range(chunk)
            n = opening + rest
            after_n = np.zeros(n + 1, bool)
            after_n[1:n] = is_n[:-1] & ~is_n[1:]
            record = record[: n + 1] if len(record) > n else np.append(record, False)
            places = np.flatnonzero(after_n | record)
            coded = np.where(record[places], -1 - places, places)
            out.append((path, key, no, opening, rest, state, int(is_n[0]) if n else -1, int(is_n[-1]) if n else -1, int(is_n[opening]) if rest else -1, int(chunk[:1] == b">"), coded.astype(np.int32)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RANGES.split(", ")])


def summaries(ranges: DataFrame) -> DataFrame:
    """What each range tells by itself, as a table; repeated rows count once."""
    return cut(ranges.mapInPandas(_summaries, RANGES).dropDuplicates([*KEYS, "range_no"]))


def stitched(found: DataFrame) -> DataFrame:
    """Ranges with the state they begin in, their first base's number in the file and the file's number of bases.

    States are carried from range to range and lengths are prefix-summed by windows over the ranges of a file. Rows
    are some numbers for 64 KB each and hold no boundaries, so a file of 10 GB has 160,000 small rows here. Whether the
    opening counts as bases follows from the state.
    """
    w = Window.partitionBy(*KEYS).orderBy("range_no")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    # the state before a range: at a line start (2) its own first byte decides
    starts_header = F.col("marked") == 1
    carried = found.drop("cuts").withColumn("_line_start", F.coalesce(F.lag("last_state").over(w) == 2, F.lit(True)))
    # a range without line ends passes on what it is given, but one that starts a line sets the state itself
    own = F.when(F.col("last_state") >= 0, F.col("last_state")).when(F.col("_line_start"), starts_header.cast("int"))
    carried = carried.withColumn("_own", own)
    before = F.coalesce(F.last("_own", ignorenulls=True).over(back), F.lit(2))
    carried = carried.withColumn("in_header", F.when(before == 2, starts_header).otherwise(before == 1))
    carried = carried.withColumn("new_record", (before == 2) & starts_header)
    bases = F.when(F.col("in_header"), F.col("rest")).otherwise(F.col("opening") + F.col("rest"))
    sized = carried.withColumn("bases", bases)
    first = F.when(F.col("in_header"), F.col("head_n")).otherwise(F.col("first_n"))
    last = F.when(F.col("in_header") & (F.col("rest") == 0), F.lit(-1)).otherwise(F.col("last_n"))
    marked = sized.withColumn("_first", first).withColumn("_last", F.when(F.col("bases") > 0, last))
    joined = (F.last("_last", ignorenulls=True).over(back) == 1) & (F.col("_first") == 0)
    whole = Window.partitionBy(*KEYS)
    return marked.select(
        *KEYS, "range_no", "opening", "in_header", "bases",
        F.coalesce(F.sum("bases").over(back), F.lit(0)).alias("base_start"), F.sum("bases").over(whole).alias("n_bases"),
        (F.coalesce(joined, F.lit(False)) | F.col("new_record")).alias("cut_before"),
    )


def boundaries(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """(sequence_path, text_key, n_bases, base_start, bases, cuts): one row per range with the sorted file-wide places where a cut is natural."""
    both = ranges.where("n_bases > 0").join(found.select(*KEYS, "range_no", "cuts"), [*KEYS, "range_no"])
    skip = F.when(F.col("in_header"), F.col("opening")).otherwise(F.lit(0))
    place = F.transform("cuts", lambda c: F.when(c < 0, -1 - c).otherwise(c) - skip)
    # inside a skipped opening nothing counts, and at its end only a record start does
    kept = F.filter(F.arrays_zip(F.col("cuts").alias("c"), place.alias("p")), lambda x: (x["p"] > 0) | ((x["p"] == 0) & (x["c"] < 0)))
    local = F.transform(kept, lambda x: x["p"].cast("long") + F.col("base_start"))
    every = F.when(F.col("cut_before"), F.array_append(local, F.col("base_start"))).otherwise(local)
    inner = F.filter(F.array_sort(F.array_distinct(every)), lambda p: (p > 0) & (p < F.col("n_bases")))
    return both.select(*KEYS, "n_bases", "base_start", "bases", inner.alias("cuts"))


PIECES = "sequence_path string, text_key long, start long, end long, natural boolean"
TURNS = "sequence_path string, text_key long, segment long, at array<int>, exit array<int>, slope array<int>"


def advance(cuts: np.ndarray, start: np.ndarray, how: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces that begin at the given places, and whether they are natural.

    A piece ends at the last boundary it can reach that still takes it forward, or else is full.
    """
    if not len(cuts):
        return start + how.most, np.zeros(len(start), bool)
    i = np.searchsorted(cuts, start + how.most, "right") - 1
    last = cuts[np.maximum(i, 0)]
    natural = (i >= 0) & (last > start + how.overlap)
    return np.where(natural, last, start + how.most), natural


def turns(cuts: np.ndarray, begin: int, end: int, n_bases: int, how: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place in a segment's beginning where its first piece may start, where the next segment's first piece does.

    Both are told as distances from their segment's begin, -1 where the file has ended. Places that end up on a line of slope 0 or 1
    are one entry (at, exit, slope): chains that meet stay together, so there are few.
    """
    place = np.arange(begin, begin + how.most - how.overlap, dtype=np.int64)
    while (going := np.flatnonzero((place >= 0) & (place < end))).size:
        value, back = np.unique(place[going], return_inverse=True)
        onward = advance(cuts, value, how)[0] - how.overlap
        place[going] = np.where(n_bases - value <= how.most, -1, onward)[back]
    out = np.where(place < 0, -1, place - end)
    slope = np.append(np.diff(out), 0)
    at = np.flatnonzero(np.append(True, np.diff(slope) != 0))
    return at, out[at], slope[at]


def chain(cuts: np.ndarray, start: int, end: int, n_bases: int, how: Pieces) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, whether the end is natural) that begin in [start, end), from one that begins at start."""
    out = []
    while start < end:
        if n_bases - start <= how.most:
            out.append((start, n_bases, True))
            break
        i = int(np.searchsorted(cuts, start + how.most, "right")) - 1
        natural = i >= 0 and cuts[i] > start + how.overlap
        stop = int(cuts[i]) if natural else start + how.most
        out.append((start, stop, bool(natural)))
        start = stop - how.overlap
    return out


def pieces_of(found: DataFrame, how: Pieces) -> DataFrame:
    """Pieces of the files whose range summaries are given; see pieces."""
    if how.segment < how.most:
        raise ValueError("a segment has to hold a piece")
    marked = boundaries(stitched(found), found)
    # a segment's pieces begin in it and reach no further than `most` bases beyond
    touched = F.sequence(F.floor(F.greatest(F.col("base_start") - how.most, F.lit(0)) / how.segment), F.floor((F.col("base_start") + F.greatest(F.col("bases") - 1, F.lit(0))) / how.segment))
    parts = marked.select(*KEYS, "n_bases", "base_start", "cuts", F.explode(touched).alias("segment")).where(F.col("segment") * how.segment < F.col("n_bases"))
    low, high = F.col("segment") * how.segment, (F.col("segment") + 1) * how.segment + how.most
    mine = F.filter("cuts", lambda c: (c >= low) & (c <= high))
    # ranges come in no order; their boundaries are sorted in the task
    segments = parts.groupBy(*KEYS, "segment").agg(F.max("n_bases").alias("n_bases"), F.flatten(F.collect_list(mine)).alias("cuts"))
    single = segments.where(F.col("n_bases") <= how.segment).withColumn("entry", F.lit(0).cast("long"))
    several = cut(segments.where(F.col("n_bases") > how.segment))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, key, no, n, cuts in zip(pdf["sequence_path"], pdf["text_key"], pdf["segment"], pdf["n_bases"], pdf["cuts"]):
                at, leave, slope = turns(np.unique(np.asarray(cuts, np.int64)), no * how.segment, (no + 1) * how.segment, n, how)
                yield pd.DataFrame({"sequence_path": [path], "text_key": [key], "segment": [no], "at": [at], "exit": [leave], "slope": [slope]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where the first piece of each segment begins: the turns, taken one after the other."""
        pdf, entry, out = pdf.sort_values("segment", ignore_index=True), 0, []
        for at, leave, slope in zip(pdf["at"], pdf["exit"], pdf["slope"]):
            out.append(entry)
            if entry >= 0:
                i = int(np.searchsorted(at, entry, "right")) - 1
                entry = int(leave[i] + slope[i] * (entry - at[i]))
        return pdf[[*KEYS, "segment"]].assign(place=out)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, key, no, n, cuts, entry in zip(pdf["sequence_path"], pdf["text_key"], pdf["segment"], pdf["n_bases"], pdf["cuts"], pdf["entry"]):
                for s, e, natural in chain(np.unique(np.asarray(cuts, np.int64)), no * how.segment + entry, (no + 1) * how.segment, n, how):
                    out.append((path, key, s, e, natural))
            yield pd.DataFrame(out, columns=[*KEYS, "start", "end", "natural"])

    columns = [*KEYS, "segment", "n_bases", "cuts", "entry"]
    rows = single.select(*columns)
    if not several.isEmpty():
        entries = several.mapInPandas(turn, TURNS).groupBy(*KEYS).applyInPandas(walk, "sequence_path string, text_key long, segment long, place long")
        rows = rows.unionByName(several.join(entries.where("place >= 0").withColumnRenamed("place", "entry"), [*KEYS, "segment"]).select(*columns))
    made = rows.mapInPandas(cut_up, PIECES)
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("start")) - 1
    return made.select(*KEYS, number.cast("long").alias("piece_no"), "start", "end", "natural")


def pieces(files: DataFrame, how: Pieces = Pieces()) -> DataFrame:
    """(sequence_path, text_key, piece_no, start, end, natural): the pieces of every file that has bases, by base offset.

    A piece has at most `most` bases; neighbours share exactly `overlap`; it ends where a record or a run of N ends
    wherever such a place lies in its reach (the last one is taken), and the file's end is natural. Files of at most
    `most` bases give one piece, files without bases, null and empty texts none. Header lines begin with `>`; bases are
    the letters of all other lines. Repeated rows count once, different texts of one path each; rows without a path are
    left out.
    A file is one chain of pieces, however long. Files of more than `segment` bases are worked on by segments: each tells
    for every place where its first piece may start where the next segment's first does, these few numbers are followed from
    segment to segment, and then all segments are cut at once.
    """
    return pieces_of(summaries(file_ranges(files.select("sequence_path", "fasta"), how)), how)


def emit_of(ranges: DataFrame, found: DataFrame, made: DataFrame, how: Pieces) -> DataFrame:
    """The pieces with their bases; see emit."""
    # pieces and ranges meet by the blocks of bases they touch; a pair is kept in the block in which its common bases begin
    blocks = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / how.range_bytes), F.floor((F.col(high) - 1) / how.range_bytes)))
    held = stitched(found).select(*KEYS, "range_no", "opening", "in_header", "base_start", (F.col("base_start") + F.col("bases")).alias("base_end")).where("base_end > base_start")
    both = held.withColumn("_block", blocks("base_start", "base_end")).join(made.withColumn("_block", blocks("start", "end")), [*KEYS, "_block"])
    wanted = both.where("start < base_end and end > base_start").where(F.floor(F.greatest("start", "base_start") / how.range_bytes) == F.col("_block"))
    # a range's text goes once to all pieces it is part of
    asked = wanted.groupBy(*KEYS, "range_no").agg(F.first("opening").alias("opening"), F.first("in_header").alias("in_header"), F.first("base_start").alias("base_start"), F.collect_list(F.struct("piece_no", "start", "end", "natural")).alias("_pieces"))
    parts = asked.join(ranges.dropDuplicates([*KEYS, "range_no"]), [*KEYS, "range_no"])

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, key, no, chunk, opening, header, base, wanted in zip(*(pdf[c] for c in (*KEYS, "range_no", "chunk", "opening", "in_header", "base_start", "_pieces"))):
                letters = read_range(bytes(chunk))[3][opening if header else 0 :]
                out += [(path, key, p["piece_no"], p["start"], p["end"], p["natural"], no, letters[max(p["start"] - base, 0) : p["end"] - base].tobytes().decode("ascii")) for p in wanted]
            yield pd.DataFrame(out, columns=[*KEYS, "piece_no", "start", "end", "natural", "range_no", "part"])

    cut_parts = parts.mapInPandas(slices, "sequence_path string, text_key long, piece_no long, start long, end long, natural boolean, range_no long, part string")
    # a piece touches few ranges: at most most / range_bytes + 1 that hold bases only
    joined = cut_parts.groupBy(*KEYS, "piece_no", "start", "end", "natural").agg(F.array_sort(F.collect_list(F.struct("range_no", "part"))).alias("_parts"))
    return joined.select(*KEYS, "piece_no", "start", "end", "natural", F.array_join("_parts.part", "").alias("bases"))


def emit(files: DataFrame, how: Pieces = Pieces()) -> DataFrame:
    """The pieces with their bases, put together from the byte ranges they touch; no file is held whole."""
    ranges = file_ranges(files.select("sequence_path", "fasta"), how)
    found = summaries(ranges)
    return emit_of(ranges, found, cut(pieces_of(found, how)), how)


def emit_stored(spark: SparkSession, folder: str, how: Pieces = Pieces()) -> DataFrame:
    """As emit, of the files of a folder, which are only ever read by ranges."""
    ranges = stored_ranges(spark, folder, how)
    found = summaries(ranges)
    return emit_of(ranges, found, cut(pieces_of(found, how)), how)


def _files(spark, folder):
    return table(spark, folder, "sequences", ["sequence_path", "fasta"])


def p3_found(spark, folder):
    """Files that had to be cut."""
    return pieces(_files(spark, folder)).where("piece_no = 1").select("sequence_path").distinct()


def p3_pieces(spark, folder):
    """Offsets of all pieces."""
    return pieces(_files(spark, folder))


def p3_bases(spark, folder):
    """All pieces with their bases."""
    return emit(_files(spark, folder))
