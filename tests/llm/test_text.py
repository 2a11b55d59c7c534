import random

import numpy as np
import pytest

from strandline.llm import mixing as mix
from strandline.llm import packing as pk
from strandline.llm import truncation as tr

DOCS = "doc_id long, text string, source string, part string, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(0.02, 400) + rng.integers(0, 30, 400), 100) if seed else np.array([100, 1, 99, 50, 50, 60, 40, 35, 25])
    number = pk.best_two_fit(sizes, 100)
    filled = np.bincount(number, sizes)
    assert filled.max() <= 100 and sorted(set(number)) == list(range(number.max() + 1))
    assert filled.sum() == sizes.sum()
    assert len(filled) <= np.ceil(sizes.sum() / 100) * 1.1 + 1


def test_smallest_gives_way_to_two_that_fit_better():
    # greedily 60 + 31; 31 gives way to 20 + 20, which fill the container
    assert pk.best_two_fit(np.array([60, 31, 20, 20]), 100).tolist() == [0, 1, 0, 0]


def test_containers(spark):
    rows = [(1, "a" * 250, "s"), (2, None, "s"), (3, "", None), (4, "é" * 30, "s"), (5, "b" * 40, "s"), (6, "c" * 100, "s"), (6, "c" * 100, "s")]
    packed = pk.pack(pk.container_items(docs(spark, rows), 100), 100).collect()
    assert sorted((r["doc_id"], r["part"], r["start"], r["size"]) for r in packed) == [(1, 0, 0, 100), (1, 1, 100, 100), (1, 2, 200, 50), (4, 0, 0, 60), (5, 0, 0, 40), (6, 0, 0, 100), (6, 0, 0, 100)]
    sums = {}
    for r in packed:
        sums[r["container_id"]] = sums.get(r["container_id"], 0) + r["size"]
    assert max(sums.values()) <= 100 and len(sums) == 6


def test_groups_pack_apart(spark):
    rows = [(i, "x" * (1 + i * 37 % 90), "s") for i in range(900)]
    packed = pk.pack(pk.container_items(docs(spark, rows), 100), 100, group_rows=100)
    report = pk.fill_report(packed, 100).first()
    assert report["items"] == 900 and report["fullest"] <= 100 and report["fill"] > 0.9
    assert pk.pack(pk.container_items(docs(spark, []), 100), 100).count() == 0


TARGETS = "source string, target_share double, max_repeats int, tokens int"


def test_mix_reaches_shares_and_respects_repeats(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(1, 40), "big" if i % 10 else "Small ") for i in range(2000)] + [(5000, None, "big"), (5001, "x" * 50, None), (5002, "x" * 50, "other")]
    targets = spark.createDataFrame([("big", 0.5, 1, 1), ("SMALL", 0.3, 2, 1), ("none", 0.2, 3, 1), (None, 0.5, 1, 1)], TARGETS)
    sized = mix.sized_documents(docs(spark, rows))
    plan = mix.mix_plan(sized, targets)
    got = {r["source"]: r for r in plan.collect()}
    assert set(got) == {"big", "small", "none"}
    mixed = mix.mix(sized, plan).collect()
    assert max(r["use"] for r in mixed) == 1
    total = got["big"]["tokens"] + got["small"]["tokens"]
    by = {s: sum(r["tokens"] for r in mixed if r["source"] == s) for s in ("big", "small")}
    assert by["big"] == pytest.approx(total * 0.5, abs=40) and by["small"] == 2 * got["small"]["tokens"]
    assert len({(r["doc_id"], r["use"]) for r in mixed}) == len(mixed)
    places = [r["position"] for r in mixed]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    shares = {r["source"]: r for r in mix.shares(mix.placed(sized, plan), plan).collect()}
    assert {s for s, r in shares.items() if r["ran_out"]} == {"small", "none"}
    assert sum(r["actual_share"] for r in shares.values()) == pytest.approx(1) and shares["none"]["actual_share"] == 0
    assert shares["none"]["last_met"] == 0 and shares["big"]["last_met"] == 1 and shares["small"]["last_met"] == pytest.approx(by["small"] / (0.3 * total), abs=1e-3)


def test_weights_add_up_at_every_point(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(1, 40), rng.choice("aaabbcd")) for i in range(12000)]
    targets = spark.createDataFrame([("a", 0.3, 1, 1), ("b", 0.3, 2, 1), ("c", 0.2, 2, 1), ("d", 0.2, 2, 1)], TARGETS)
    sized = mix.sized_documents(docs(spark, rows))
    plan = mix.mix_plan(sized, targets, {"a": -0.9, "b": 0.4, "c": 0.1})
    tilts = {r["source"]: (r["tilt"], r["budget"]) for r in plan.collect()}
    assert sum(t * b for t, b in tilts.values()) == pytest.approx(0, abs=1e-6) and tilts["d"][0] == 0 and tilts["b"][0] == pytest.approx(0.4)
    mixed = mix.mix(sized, plan).collect()
    total = sum(r["tokens"] for r in mixed)
    for i in range(5):
        part = [r for r in mixed if i / 5 <= r["position"] < (i + 1) / 5]
        n = sum(r["tokens"] for r in part)
        assert n / total == pytest.approx(0.2, rel=0.01)
        assert sum(r["tokens"] for r in part if r["source"] == "d") / n == pytest.approx(0.2, rel=0.01)
        # the integral of 1 - k + 2 k t over the fifth
        assert sum(r["tokens"] for r in part if r["source"] == "a") / n == pytest.approx(0.3 * (1 + tilts["a"][0] * ((2 * i + 1) / 5 - 1)), rel=0.02)
    one_sided = mix.mix_plan(sized, targets, {"a": 0.5, "b": 0.2}).collect()
    assert all(r["tilt"] == 0 for r in one_sided)


def test_demand_just_met_is_no_case(spark):
    rows = [(i, "x" * 10, "a") for i in range(10)] + [(100, "x" * 100, "b")]
    for share, ran_out in ((0.499, False), (0.5, False), (0.501, True)):
        targets = spark.createDataFrame([("a", share, 1, 1), ("b", 1 - share, 2, 1)], TARGETS)
        sized = mix.sized_documents(docs(spark, rows))
        plan = mix.mix_plan(sized, targets)
        assert {r["source"]: r["ran_out"] for r in mix.shares(mix.placed(sized, plan), plan).collect()} == {"a": ran_out, "b": False}


def test_mix_of_nothing(spark):
    sized = mix.sized_documents(docs(spark, []))
    targets = spark.createDataFrame([("a", 1.0, 2, 1)], TARGETS)
    plan = mix.mix_plan(sized, targets, {"a": 1.0})
    assert mix.mix(sized, plan).count() == 0 and mix.shares(mix.placed(sized, plan), plan).where("ran_out").count() == 0
    assert mix.mix_plan(sized, targets.limit(0)).count() == 0


def ruling(rng, end):
    words = "the appeal court held that this claim for unpaid rent under a lease of land was not proved by any witness".split()
    body = "\n\n".join(f"[{i}] " + " ".join(rng.choice(words) for _ in range(40)) + "." for i in range(6))
    return f"Court of Velmark\n\n{body}\n\n{end}"


def test_truncation(spark):
    rng = random.Random(2)
    ends = ["The order below is set aside.\n\n(signed) {}, Judge", "So ordered.", "Costs reserved\n\nDated 3 May 20{}", "Appeal dismissed.\n\n{}\nfor the Court\n\nPage 3 of 3"]
    rows = [(i, ruling(rng, rng.choice(ends).format(rng.choice(["Norton", "Draberg", "11", "R.____"]))), "a") for i in range(160)]
    cut_ids = []
    for i in range(200, 230):
        whole = ruling(rng, "So ordered.")
        rows.append((i, whole[: rng.randint(300, len(whole) - 60)] + ["", "...", "…", "\n\nPage 2 of 3", "\n["][i % 5], " B-"))
        cut_ids.append(i)
    rows += [(400, None, "a"), (401, "  \n", "a"), (402, rows[0][1], None), (403, "Hm", "a"), (404, ruling(rng, "So ordered.") * 60, "a")]
    flags = {r["doc_id"]: r for r in tr.truncated(docs(spark, rows)).collect()}
    assert {i for i, r in flags.items() if r["truncated"]} == {*cut_ids, 403}
    assert not {400, 401} & set(flags) and flags[402]["source"] is None
    by = {r["source"]: (r["n_texts"], r["n_truncated"]) for r in tr.by_source(tr.truncated(docs(spark, rows))).collect()}
    assert {flags[i]["evidence"] for i in flags if not flags[i]["truncated"]} == {None} and flags[403]["evidence"] == "unseen" and sum(flags[i]["evidence"] == "inner" for i in cut_ids) > 4
    assert by["b"] == (30, 30) and by["a"] == (162, 1) and by[None] == (1, 0)
    assert tr.truncated(docs(spark, [])).count() == 0


def test_copies_and_versions_of_a_cut_text_are_found(spark):
    rng = random.Random(3)
    rows = [(i, ruling(rng, rng.choice(["So ordered by {}.", "The appeal of {} is dismissed."]).format(rng.choice(["Norton", "Draberg"]))), "a") for i in range(60)]
    rows += [(i, rows[0][1], "a") for i in range(60, 90)]
    whole = ruling(rng, "So ordered by Norton.")
    rows += [(200 + i, whole[:700], "b") for i in range(20)]
    rows += [(300 + i, f"Version {'abcde'[i]} of this ruling\n\n" + whole[:900], "b") for i in range(5)]
    flags = {r["doc_id"]: r["truncated"] for r in tr.truncated(docs(spark, rows)).collect()}
    assert len(flags) == 115 and {i for i, cut in flags.items() if cut} == {i for i in flags if i >= 200}


def test_a_small_sources_own_closing_counts_beside_large_ones(spark):
    rng = random.Random(4)
    rows = [(i, ruling(rng, f"Filed by clerk {rng.choice(['Norton', 'Draberg'])} in the northern registry."), "rare") for i in range(9)]
    rows += [(9 + i, ruling(rng, "Filed by clerk Norton in the northern registry.")[:500], "rare") for i in range(3)]
    rows += [(1000 + i, ruling(rng, "So ordered."), "large") for i in range(6000)]
    flags = {r["doc_id"]: r["truncated"] for r in tr.truncated(docs(spark, rows)).collect()}
    assert {i for i, cut in flags.items() if cut} == {9, 10, 11}


@pytest.mark.parametrize("few", [0, 4_000_000])
def test_a_final_trigram_that_ends_hardly_any_text_is_counted_inside(spark, few):
    rng = random.Random(6)

    def text(end, quoted=False):
        names = " ".join("".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(30))
        return f"The witness saw nothing that day. {'It was said that the motion is granted at times. ' if quoted else ''}{names} {end}"

    # the order stands at ends two times in three, so it is no closing
    rows = [(i, text("the motion is granted", i % 2 == 0), "a") for i in range(40)]
    rows += [(100, text("the motion is granted because witness saw nothing"), "a"), (101, text("while saw nothing that"), "a"), (102, text("though nothing that day the motion is granted"), "a"), (103, text("unlike"), "a")]
    flags = {r["doc_id"]: r["evidence"] for r in tr.truncated(docs(spark, rows), tr.Ends(few=few)).collect() if r["truncated"]}
    assert flags == {100: "inner", 101: "inner", 103: "unseen"}


@pytest.mark.parametrize("reach", [1, 8, 30, 90, 5000])
def test_last_lines_hold_the_final_words_of_the_whole_text(spark, reach):
    rng = random.Random(reach)
    parts = ["one", "Zwei", "s48A", "\n", "\r\n", "\n\n", " ", "…", "¶ 7", "12.5", "Page 2 of 3", "\nPage 1 of 9 x-1\n", "é" * 40, "\t", "a" * 100]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", " "]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " \n ", "x", "\n" * 50, "long " * 2000]
    df = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    assert tr.truncated(df).count() == sum(bool(t and t.strip()) for t in texts)
    last = spark.sql(tr._final_words(20, reach), tr.PATTERNS, docs=df)
    whole = spark.sql(f"select doc_id, {tr._words('trim(text)')} as w from {{docs}} where text rlike :ink", tr.PATTERNS, docs=df)
    assert {r["doc_id"]: r["w"] for r in last.collect()} == {r["doc_id"]: r["w"][-20:] for r in whole.collect()}
