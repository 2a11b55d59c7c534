import random
import re

import numpy as np
import pytest

from strandline.llm.splitting import Pieces, chain, emit, emit_stored, pieces, turns

FILES = "sequence_path string, fasta string, segment string"


def parse(text):
    """Bases of a text, and the places where a record or a run of N ends."""
    out, starts = "", set()
    for line in re.split(r"[\r\n]", text or ""):
        if line.startswith(">"):
            starts.add(len(out))
        else:
            out += re.sub("[^A-Za-z]", "", line)
    runs = {m.end() for m in re.finditer("[Nn]+", out)}
    return out, {p for p in starts | runs if 0 < p < len(out)}


def random_text(rng, n):
    parts = []
    for i in range(rng.randint(1, 6)):
        parts.append(rng.choice([">rec NNN acgt", ">", "", ">x\tN"]))
        for _ in range(rng.randint(0, n)):
            parts.append("".join(rng.choice("ACGTacgtNNnnRY") * rng.choice([1, 1, 1, 7]) for _ in range(rng.randint(0, 12))) + rng.choice(["", " "]))
    return rng.choice(["\n", "\r\n", "\r"]).join(parts) + rng.choice(["", "\n"])


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [random_text(rng, 9) for _ in range(120)] + ["", "\n", ">only", ">a\n>b\n", "ACGT" * 100, "N" * 333, ">h\n" + "ACGTN" * 90]
    how = Pieces(most=40, overlap=6, range_bytes=16, segment=96)
    files = spark.createDataFrame([(f"f{i}", t, "x") for i, t in enumerate(texts)] + [("null", None, None), (None, "ACGT", None)], FILES)
    made = emit(files, how).collect()
    by = {}
    for r in made:
        by.setdefault(r["sequence_path"], []).append(r)
    assert None not in by and "null" not in by
    for i, t in enumerate(texts):
        bases, natural = parse(t)
        mine = sorted(by.get(f"f{i}", []), key=lambda r: r["piece_no"])
        assert bool(mine) == bool(bases)
        if not bases:
            continue
        assert [r["piece_no"] for r in mine] == list(range(len(mine)))
        assert mine[0]["start"] == 0 and mine[-1]["end"] == len(bases)
        for r in mine:
            assert r["bases"] == bases[r["start"] : r["end"]] and 0 < len(r["bases"]) <= how.most
        for a, b in zip(mine, mine[1:]):
            assert a["end"] - b["start"] == how.overlap
            reach = [p for p in natural if a["start"] + how.overlap < p <= a["start"] + how.most]
            assert a["natural"] == (a["end"] in natural)
            if reach:
                assert a["natural"], (t, a)
        assert (len(bases) > how.most) == (len(mine) > 1)


def test_neither_ranges_nor_segments_change_a_piece(spark):
    rng = random.Random(6)
    texts = [random_text(rng, 12) for _ in range(30)] + ["A" * 900, ">x\n" + "AN" * 700, ">x\n" + ("ACGTACGT" + "N" * 3) * 120, "".join(rng.choice("ACGT" * 9 + "N") for _ in range(2000))]
    files = spark.createDataFrame([(f"f{i}", t, None) for i, t in enumerate(texts)], FILES)
    key = lambda df: sorted((r["sequence_path"], r["piece_no"], r["start"], r["end"], r["natural"]) for r in df.collect())
    whole = key(pieces(files, Pieces(50, 5, 1 << 16, 1 << 20)))
    for range_bytes, segment in ((11, 1 << 20), (1 << 16, 50), (16, 64), (64, 333)):
        assert key(pieces(files, Pieces(50, 5, range_bytes, segment))) == whole
    with pytest.raises(ValueError):
        pieces(files, Pieces(50, 5, 16, 49))


@pytest.mark.parametrize("seed", range(4))
def test_turns_tell_where_a_chain_goes_on(seed):
    rng, how = random.Random(seed), Pieces(60, 7, 16, 200)
    n = 700
    cuts = np.array(sorted(rng.sample(range(1, n), [0, 5, 60, 300][seed])), np.int64)
    for begin in (0, 200, 400, 600):
        at, leave, slope = turns(cuts, begin, begin + 200, n, how)
        assert len(at) <= 53
        for d in range(how.most - how.overlap):
            made = chain(cuts, begin + d, begin + 200, n, how)
            onward = made[-1][1] - how.overlap if made and made[-1][1] < n else -1
            i = int(np.searchsorted(at, d, "right")) - 1
            got = int(leave[i] + slope[i] * (d - at[i]))
            if begin + d < n - how.overlap:
                assert got == (onward - begin - 200 if onward >= 0 else -1)


def test_files_of_a_folder_are_read_by_ranges(spark, tmp_path):
    rng = random.Random(8)
    texts = {f"f{i}.fa": random_text(rng, 12) for i in range(12)} | {"empty.fa": "", "deep/one.fa": ">a\n" + "ACGT" * 50}
    for name, t in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(t.encode())
    how = Pieces(40, 6, 16, 96)
    rows = lambda df: sorted((r["sequence_path"].split("/")[-1], r["piece_no"], r["start"], r["bases"]) for r in df.collect())
    table = spark.createDataFrame([(name.split("/")[-1], t, None) for name, t in texts.items()], FILES)
    assert rows(emit_stored(spark, str(tmp_path), how)) == rows(emit(table, how))


def test_a_file_larger_than_two_gigabytes(spark, tmp_path):
    head, tail, gap = b">a\n" + b"ACGT" * 2000, b"\n>b\n" + b"TTGC" * 1500 + b"\n", (1 << 31) + 12345
    with open(tmp_path / "giant.fa", "wb") as f:  # the gap takes no disk; bytes that are no letters are no bases
        f.write(head)
        f.seek(gap, 1)
        f.write(tail)
    made = sorted(emit_stored(spark, str(tmp_path), Pieces(4096, 256, 1 << 25, 1 << 20)).collect(), key=lambda r: r["piece_no"])
    assert [(r["start"], r["end"]) for r in made] == [(0, 4096), (3840, 7936), (7680, 8000), (7744, 11840), (11584, 14000)]
    whole = "ACGT" * 2000 + "TTGC" * 1500
    assert all(r["bases"] == whole[r["start"] : r["end"]] for r in made)


def test_repeated_rows_and_other_texts_of_a_path(spark):
    files = spark.createDataFrame([("p", ">a\n" + "A" * 30, None)] * 3 + [("p", "C" * 10, None)], FILES)
    assert sorted((r["start"], r["end"]) for r in pieces(files, Pieces(20, 2, 8)).collect()) == [(0, 10), (0, 20), (18, 30)]


def test_empty_table(spark):
    assert pieces(spark.createDataFrame([], FILES)).count() == 0


@pytest.mark.parametrize("cuts, expected", [([], [(0, 10), (8, 18), (16, 25)]), ([7, 10, 24], [(0, 10), (8, 18), (16, 25)]), ([9], [(0, 9), (7, 17), (15, 25)])])
def test_chain(cuts, expected):
    assert [x[:2] for x in chain(np.array(cuts, np.int64), 0, 100, 25, Pieces(10, 2))] == expected
