"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from strandline.llm import grouped_splits, mixing, overlaps, packing, sampling, splitting, truncation
from strandline.runtime import cut, table

# The curriculum of the registered queries: the portal early, the curated mirror and patents late.
TILTS = {"court_portal": -0.5, "law_school_mirror": 0.6, "patent_bench": 0.4}


def _mix_parts(spark, folder):
    sized = cut(mixing.sized_documents(table(spark, folder, "documents", ["doc_id", "source", "text"])))
    return sized, mixing.mix_plan(sized, table(spark, folder, "mix_targets"), TILTS)


def p7_found(spark, folder):
    """Sources whose demand runs past the last of their permitted uses in the mix."""
    sized, plan = _mix_parts(spark, folder)
    return mixing.shares(mixing.placed(sized, plan), plan).where("ran_out").select("source")


def p7_mix(spark, folder):
    """The mixed corpus in training order."""
    return mixing.mix(*_mix_parts(spark, folder))


def p7_shares(spark, folder):
    """Shares really reached."""
    sized, plan = _mix_parts(spark, folder)
    return mixing.shares(mixing.placed(sized, plan), plan)


QUERIES = {f.__name__: f for f in (
    sampling.p1_found, sampling.p1_sample, sampling.p1_report,
    splitting.p3_found, splitting.p3_pieces, splitting.p3_bases,
    overlaps.p4_found, overlaps.p4_pairs, overlaps.p4_report, overlaps.p4_members,
    grouped_splits.p5_found, grouped_splits.p5_assignment, grouped_splits.p5_shares, grouped_splits.p5_forest,
    packing.p6_found, packing.p6_containers, packing.p6_fill,
    p7_found, p7_mix, p7_shares,
    truncation.p8_found, truncation.p8_by_source,
)}


def _key(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_'), '')"


_KNOWN = "('train', 'val_overlapped', 'val_outside', 'test_overlapped', 'test_outside')"

_RECORDS = f"""select distinct * from (select {_key('partition_label')} as partition_label, {_key('species')} as species, phenotype, genome_id, {_key('antibiotic')} as antibiotic
  from tiny_manifest) where partition_label in {_KNOWN} and species is not null and antibiotic is not null and phenotype in (0, 1) and genome_id is not null"""

_TARGETS = f"""select {_key('partition_label')} as partition_label, {_key('species')} as species, phenotype, sum(target_share::decimal(12,6)) as target_share, max(min_rows) as min_rows
  from sample_targets group by all"""

_ROWS = f"select genome_id, {_key('species')} as species, {_key('partition_label')} as split from tiny_manifest"

_SIZED = f"select doc_id, {_key('source')} as source, coalesce(strlen(text), 0) as tokens from documents"

# the operator's rule on whole tables, with its production parameters: 20 final words, endings of 40, closings at nine ends in ten;
# it lacks inner trigrams without support, so it can miss texts that the operator finds
_FLAGS = f"""with words as (select doc_id, {_key('source')} as source, {_key('lang')} as lang, list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(trim(text, ' '),
    '(?m)^\\p{{L}}+ [0-9]+ \\p{{L}}+ [0-9]+\\b.*$', ' ', 'g'), '[0-9]+', '9', 'g'), '[\\n\\r]\\s*', ' ¶ ', 'g'), '[^\\p{{L}}\\p{{N}}¶]+'), lambda x: x <> '') as w
  from documents where regexp_matches(text, '\\S')),
ended as (select *, array_to_string(w[greatest(len(w) - 39, 1):], ' ') as ending, w[greatest(len(w) - 19, 1):] as z from words),
finals as (select doc_id, source, lang, ending, list_transform(range(greatest(len(z) - 3, 0) + 1), lambda i: concat_ws(' ', z[i + 1], z[i + 2], z[i + 3])) as tail from ended),
once as (select source, lang, ending, any_value(tail) as tail from finals group by all),
least as (select source, lang, greatest(3, 0.3::double * sqrt(count(*))) as l from once group by all),
c as (select source, lang, t, count(*) as n from (select source, lang, unnest(list_distinct(tail)) as t from once) group by all),
at_ends as (select t, sum(n) as e from c join least l on c.source is not distinct from l.source and c.lang is not distinct from l.lang group by t having bool_or(n >= l)),
inside as (select t, count(*) as i from (select unnest(list_distinct(list_transform(range(greatest(len(w) - 20, 0)), lambda i: concat_ws(' ', w[i + 1], w[i + 2], w[i + 3])))) as t from ended where doc_id in (select min(doc_id) from ended group by ending)) where t in (select t from at_ends) group by t),
known as (select t, e::double / (e + coalesce(i, 0)) as share from at_ends left join inside using (t)),
j as (select doc_id, max(share) as most, min(share) as least, arg_max(share, place) filter (where share is not null) as last
  from (select doc_id, unnest(tail) as t, unnest(range(len(tail))) as place from finals) left join known using (t) group by doc_id),
flags as (select doc_id, source, most is null or (most < 0.9::double and (least <= 0.1::double or last < 0.5)) as truncated from finals join j using (doc_id))"""

ORACLE = {
    "p8_found": f"{_FLAGS} select doc_id from flags where truncated",
    "p8_by_source": f"{_FLAGS} select source, count(*) as n_texts, count(*) filter (where truncated) as n_truncated, round(avg(truncated::int), 6) as truncated_rate from flags group by source",
    "p1_found": f"""with r as ({_RECORDS}), s as (select partition_label, count(distinct (genome_id, antibiotic)) as n from r group by 1),
  a as (select partition_label, species, phenotype, count(*) as n from r group by all)
select t.partition_label, t.species, t.phenotype from ({_TARGETS}) t left join s using (partition_label)
  left join a on a.partition_label = t.partition_label and a.species = t.species and a.phenotype = t.phenotype
where coalesce(a.n, 0) < greatest(ceil(t.target_share * (coalesce(s.n, 0) // 5)), t.min_rows)""",
    "p3_found": r"""select sequence_path from sequences
where length(regexp_replace(array_to_string(list_filter(string_split_regex(fasta, '[\r\n]'), lambda x: not starts_with(x, '>')), ''), '[^A-Za-z]', '', 'g')) > 4096""",
    "p5_found": f"""with r as (select * from ({_ROWS}) where split in {_KNOWN})
select 'genome' as entity_kind, genome_id as entity_key from r where genome_id is not null group by genome_id having count(distinct split_part(split, '_', 1)) > 1
union all select 'species', species from r where species is not null group by species having bool_or(split = 'train') and bool_or(split in ('val_outside', 'test_outside'))""",
    "p5_forest": f"""select genome_id, species, count(*) as n_rows from ({_ROWS}) where genome_id is not null and species is not null group by all""",
    "p6_found": "select doc_id from documents where strlen(text) > 4096",
    "p7_found": f"""with d as ({_SIZED}), m as (select {_key('source')} as source, sum(target_share::decimal(12,6)) as share, max(max_repeats) as reps from mix_targets group by 1),
  h as (select source, sum(tokens)::bigint as n from d group by 1)
select m.source from m left join h using (source) where m.share * (select sum(n)::bigint from h where source in (select source from m)) > m.reps * coalesce(h.n, 0)""",
}
