"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import scalars as sc
from strandline.functions.keys import SPLIT_GROUP
from strandline.operators import metrics as met
from strandline.operators import models
from strandline.operators import relational as rel
from strandline.operators import sequences as seq
from strandline.operators import statistics as sta
from strandline.operators import vectors as vec
from strandline.operators.ordering import numbered
from strandline.runtime import table
from strandline.sources import files as src

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- tables as the queries see them


def manifest(s: SparkSession, d: str) -> DataFrame:
    return rel.tidy_manifest(table(s, d, "tiny_manifest", ["row_id", "genome_id", "species", "antibiotic", "phenotype", "partition_label", "sequence_path", "source_dataset"]))


def metadata(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "genome_metadata", ["genome_id", "gtdb_species", "ncbi_species_name"])


def labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kover_labels").where("genome_id is not null")


def predictions(s: SparkSession, d: str) -> DataFrame:
    y = F.col("phenotype")
    return manifest(s, d).select(
        "row_id", F.col("antibiotic").alias("grp"), y.alias("y_true"), F.when(F.col("row_id") % 3 == 0, 1 - y).otherwise(y).alias("y_pred"),
        (((F.col("row_id") * 7919) % 1000).cast("double") / 2000.0 + y * 0.25).alias("y_score"),
    )


def vectors(s: SparkSession, d: str) -> DataFrame:
    lab, i = F.col("label"), F.col("vec_id")
    split = F.when(lab == 8, "val_outside").when(lab == 9, "test_outside").when(i % 10 == 0, "val_overlapped").when(i % 10 == 1, "test_overlapped").otherwise("train")
    return table(s, d, "embeddings").select("vec_id", "label", sc.doubles(F.col("embedding")).alias("v"), ((lab + F.when(i % 3 == 0, 1).otherwise(0)) % 2).cast("int").alias("phenotype"), split.alias("split"))


def tokens(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events", ["user_id", "ts", "event_id", "value"])
    return numbered(e, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts")).select("user_id", "t", F.col("value").alias("x"))


_K = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), '')"
_SPLITS = "('train', 'val_overlapped', 'val_outside', 'test_overlapped', 'test_outside')"
M = f"""m as (select * from (select row_id, genome_id, {_K.format('species')} as species, {_K.format('antibiotic')} as antibiotic, phenotype, {_K.format('partition_label')} as split,
  sequence_path, source_dataset from tiny_manifest) where split in {_SPLITS} and species is not null and antibiotic is not null and phenotype in (0, 1) and genome_id is not null)"""
P = M + """, p as (select row_id, antibiotic as grp, phenotype as y_true, case when row_id % 3 = 0 then 1 - phenotype else phenotype end as y_pred,
  ((row_id * 7919) % 1000)::double / 2000.0::double + phenotype * 0.25::double as y_score from m)"""
V = """v as (select vec_id, label, embedding::double[] as v, ((label + case when vec_id % 3 = 0 then 1 else 0 end) % 2)::int as phenotype,
  case when label = 8 then 'val_outside' when label = 9 then 'test_outside' when vec_id % 10 = 0 then 'val_overlapped' when vec_id % 10 = 1 then 'test_overlapped' else 'train' end as split from embeddings)"""
T = "t as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as x from events)"


# ---------------------------------------------------------------- sources


@query("select sequence_path, length(s) as n_bases, md5(upper(s)) as bases_md5 from (select sequence_path, regexp_replace(array_to_string(list_filter(string_split_regex(fasta, '[\\r\\n]+'), lambda x: not starts_with(x, '>')), ''), '[ \\t]', '', 'g') as s from sequences)")
def src10_fasta(s, d):
    return src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"])).select("sequence_path", F.length("sequence").cast("long").alias("n_bases"), F.md5("sequence").alias("bases_md5"))


@query("""with f as (select sequence_path, upper(regexp_replace(array_to_string(list_filter(string_split_regex(fasta, '[\\r\\n]+'), lambda x: not starts_with(x, '>')), ''), '[ \\t]', '', 'g')) as s from sequences),
w as (select sequence_path, unnest([s[i:i + k - 1] for i in range(1, length(s) - k + 2)]) as kmer from f, (values (1), (2), (3)) as x(k))
select sequence_path, kmer, count(*) as n from w where regexp_full_match(kmer, '[ACGT]+') group by all""")
def rep05_kmer_counts(s, d):
    sequences = src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"]))
    return seq.kmer_counts(sequences, "sequence_path", "sequence")


@query("select distinct case when regexp_extract(n, '^([0-9]+[.][0-9]+)', 1) <> '' then regexp_extract(n, '^([0-9]+[.][0-9]+)', 1) else regexp_replace(n, '(_raw|_contigs)?[.].*$', '') end as genome_id from (select regexp_extract(sequence_path, '([^/]+)$', 1) as n from sequences)")
def src13_ids_from_names(s, d):
    return table(s, d, "sequences", ["sequence_path"]).select(sc.genome_of_path(F.col("sequence_path")).alias("genome_id")).distinct()


@query("select sequence_path, window_idx from (select sequence_path from sequences order by sha1(sequence_path), sequence_path limit 50), (select unnest(range(6)) as window_idx)")
def src19_stable_windows(s, d):
    first = table(s, d, "sequences", ["sequence_path"]).orderBy(F.sha1("sequence_path"), "sequence_path").limit(50)
    return first.select("sequence_path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("window_idx"))


@query("select coalesce(max(try_cast(nullif(regexp_extract(subset_name, '([0-9]+)$', 1), '') as int)), 0) + 1 as next_number from used_registry")
def src18_next_number(s, d):
    n = F.regexp_extract("subset_name", "([0-9]+)$", 1).try_cast("int")
    return table(s, d, "used_registry").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_number"))


# ---------------------------------------------------------------- filters


@query(f"with {M} select row_id, genome_id from m where split = 'train'")
def flt01_partition(s, d):
    return manifest(s, d).where("split = 'train'").select("row_id", "genome_id")


@query(f"with {M} select row_id, genome_id from m where genome_id not in (select genome_id from used_registry where genome_id is not null)")
def flt02_not_used(s, d):
    return manifest(s, d).select("row_id", "genome_id").join(table(s, d, "used_registry", ["genome_id"]), "genome_id", "left_anti")


@query(f"with {M} select distinct l.genome_id, l.antibiotic_label from kover_labels l where l.genome_id in (select genome_id from m where split = 'train')")
def flt03_train_only(s, d):
    return labels(s, d).select("genome_id", "antibiotic_label").join(manifest(s, d).where("split = 'train'").select("genome_id"), "genome_id", "left_semi").distinct()


@query("select genome_id, gtdb_species from genome_metadata where gtdb_species is not null")
def flt04_named(s, d):
    return metadata(s, d).where("gtdb_species is not null").select("genome_id", "gtdb_species")


@query(f"with {T} select user_id, row_number() over (partition by user_id order by t) - 1 as t, x from t where case when t % 5 = 0 then 0.0 when t % 7 = 0 then 1.0 end is null or t % 5 <> 0 and t % 7 = 0")
def flt05_valid_mask(s, d):
    masked = tokens(s, d).withColumn("mask", F.expr("case when t % 5 = 0 then 0D when t % 7 = 0 then 1D end"))
    return rel.valid_positions(masked, ["user_id"], "t", "mask").select("user_id", "t", "x")


@query(f"with {M} select species, antibiotic, count(*) as n from m group by all having count(*) >= 20")
def flt06_frequent_tasks(s, d):
    return manifest(s, d).groupBy("species", "antibiotic").agg(F.count("*").alias("n")).where("n >= 20")


@query("select doc_id, i as window_idx, substr(text, i * 400 + 1, 400) as chunk from (select doc_id, text, unnest(range((length(text) + 399) // 400)) as i from documents) where length(substr(text, i * 400 + 1, 400)) >= 50")
def flt08_win03_chunks(s, d):
    return seq.chunks(table(s, d, "documents", ["doc_id", "text"]), "doc_id", "text", 400, 50)


@query("select row_id, case when phenotype is null or phenotype not in (0, 1) then 'phenotype' when trim(coalesce(genome_id, '')) = '' then 'genome_id' else 'species' end as error from tiny_manifest where phenotype is null or phenotype not in (0, 1) or trim(coalesce(genome_id, '')) = '' or trim(coalesce(species, ''), ' ') = ''")
def flt13_row_errors(s, d):
    return rel.row_errors(table(s, d, "tiny_manifest", ["row_id", "genome_id", "species", "phenotype"])).select("row_id", "error")


@query(f"with {M} select row_id from m where ('0x' || substr(md5(row_id::varchar || ':42'), 1, 6))::bigint % 4 = 1")
def flt12_shard(s, d):
    h = F.conv(F.substr(sc.hash_order(F.col("row_id")), F.lit(1), F.lit(6)), 16, 10).cast("long")
    return manifest(s, d).where(h % 4 == 1).select("row_id")


@query(f"with {M} select genome_id, antibiotic, row_id, phenotype from (select *, row_number() over (partition by genome_id, antibiotic order by row_id desc) as r from m) where r = 1")
def set04_latest_row(s, d):
    return rel.latest(manifest(s, d).select("genome_id", "antibiotic", "row_id", "phenotype"), ["genome_id", "antibiotic"], ["row_id"])


# ---------------------------------------------------------------- joins


@query("select l.genome_id, l.partition_label, l.antibiotic_label, m.gtdb_species from kover_labels l join (select distinct genome_id, gtdb_species from genome_metadata) m using (genome_id)")
def joi01_labels_metadata(s, d):
    return labels(s, d).join(metadata(s, d).select("genome_id", "gtdb_species").distinct(), "genome_id").select("genome_id", "partition_label", "antibiotic_label", "gtdb_species")


@query("select l.genome_id, l.antibiotic_label, m.n from kover_labels l left join (select genome_id, count(*) as n from genome_metadata group by 1) m using (genome_id) where l.genome_id is not null")
def joi02_left(s, d):
    m = metadata(s, d).groupBy("genome_id").agg(F.count("*").alias("n"))
    return labels(s, d).join(m, "genome_id", "left").select("genome_id", "antibiotic_label", "n")


@query(f"with {M} select m.row_id, m.sequence_path from m join sequences using (sequence_path)")
def joi03_existing_files(s, d):
    return manifest(s, d).join(table(s, d, "sequences", ["sequence_path"]), "sequence_path").select("row_id", "sequence_path")


@query(f"with {M} select distinct genome_id from m where genome_id in (select genome_id from kover_labels)")
def joi04_semi(s, d):
    return manifest(s, d).join(labels(s, d), "genome_id", "left_semi").select("genome_id").distinct()


_NORM = "lower(trim(case when regexp_full_match({0}, '[0-9]+[.][0-9]+') then regexp_replace(regexp_replace({0}, '^0+([0-9])', '\\1'), '([.][0-9]+?)0*$', '\\1') else {0} end))"


@query(f"""with i as (select distinct genome_id from used_registry where genome_id is not null), l as (select genome_id, min(antibiotic_label) as v from kover_labels where genome_id is not null group by 1),
n as (select {_NORM.format('genome_id')} as k, min(antibiotic_label) as v from kover_labels where genome_id is not null group by 1)
select i.genome_id, coalesce(l.v, n.v) as antibiotic_label from i left join l using (genome_id) left join n on n.k = {_NORM.format('i.genome_id')}""")
def joi06_two_tier(s, d):
    ids = table(s, d, "used_registry", ["genome_id"]).dropna().distinct()
    return rel.two_tier_lookup(ids, labels(s, d), "genome_id", "antibiotic_label")


@query(f"""with {M}, a as (select distinct genome_id, {_NORM.format('genome_id')} as k from m), b as (select distinct genome_id, {_NORM.format('genome_id')} as k from kover_labels where genome_id is not null)
select a.genome_id as id_a, b.genome_id as id_b from a join b using (k) where a.genome_id <> b.genome_id""")
def joi11_ambiguous_ids(s, d):
    return rel.ambiguous_ids(manifest(s, d), labels(s, d), "genome_id")


@query("""with n as (select genome_id, gtdb_species from genome_metadata where gtdb_species is not null), f as (select genome_id, min(gtdb_species) as s from n group by 1),
p as (select split_part(genome_id, '.', 1) as t, min(gtdb_species) as s from n where genome_id is not null group by 1)
select i.genome_id, coalesce(p.s, f.s, 'Unknown_' || i.genome_id) as gtdb_species from (select distinct genome_id from kover_labels where genome_id is not null) i
left join p on p.t = split_part(i.genome_id, '.', 1) left join f using (genome_id)""")
def joi09_prefix_species(s, d):
    return rel.species_by_prefix(labels(s, d).select("genome_id").distinct(), metadata(s, d), "genome_id", "gtdb_species")


@query(f"with {M} select genome_id from m intersect select genome_id from kover_labels")
def joi10_set02_common(s, d):
    return manifest(s, d).select("genome_id").intersect(labels(s, d).select("genome_id"))


_KNN = f"""with {V}, q as (select * from v where vec_id % 100 = 0), x as (select q.vec_id as query, v.vec_id as neighbour,
  round(list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v))), 9) as score from q join v on v.split = 'train' and v.vec_id <> q.vec_id),
k as (select *, row_number() over (partition by query order by score desc, neighbour) as rank from x qualify rank <= 20)"""


def _knn(s, d):
    v = vectors(s, d)
    return v, vec.nearest(v.where("vec_id % 100 = 0"), v.where("split = 'train'"), "vec_id", "v", 20)


@query(_KNN + " select query, neighbour, rank, round(score, 6) as score from k")
def joi07_nearest_cosine(s, d):
    return _knn(s, d)[1].select("query", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""with {V}, x as (select q.vec_id as query, v.vec_id as neighbour, round(list_distance(q.v, v.v), 9) as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query, neighbour, rank, round(score, 6) as score from (select *, row_number() over (partition by query order by score, neighbour) as rank from x) where rank <= 9""")
def joi08_nearest_euclidean(s, d):
    v = vectors(s, d)
    return vec.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "v", 9, "euclidean").select("query", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_KNN + """ select k.query, q.phenotype as y_true, count(*) filter (where b.phenotype = 1) as n_one, count(*) filter (where b.phenotype = 0) as n_zero,
  (count(*) filter (where b.phenotype = 1) > count(*) filter (where b.phenotype = 0))::int as y_pred from k join v q on q.vec_id = k.query join v b on b.vec_id = k.neighbour group by all""")
def met13_votes(s, d):
    v, n = _knn(s, d)
    return vec.votes(n, v, "vec_id", "phenotype").select("query", "y_true", "n_one", "n_zero", "y_pred")


@query(_KNN + """ select k.query, neighbour, rank, (q.label = b.label) as same_label, (q.phenotype = b.phenotype) as same_phenotype from k join v q on q.vec_id = k.query join v b on b.vec_id = k.neighbour""")
def joi07_match_flags(s, d):
    v, n = _knn(s, d)
    return vec.match_flags(n, v, "vec_id", ["label", "phenotype"]).withColumn("rank", F.col("rank").cast("long")).drop("score")


@query(_KNN + ", u as (select neighbour, count(*) as n from k group by 1) select count(*) as n_used, sum(n)::bigint as n_links, round(avg(n), 6) as mean_usage, max(n) as max_usage, min(n) as min_usage from u")
def agg18_usage_summary(s, d):
    return vec.usage_summary(_knn(s, d)[1])


@query(_KNN + """, r as (select k.query, q.label, q.phenotype as y, (count(*) filter (where b.phenotype = 1) > count(*) filter (where b.phenotype = 0))::int as p from k join v q on q.vec_id = k.query join v b on b.vec_id = k.neighbour group by all)
select label, y as phenotype, count(*) as total, count(*) filter (where y = p) as correct, round(count(*) filter (where y = p)::double / count(*), 6) as accuracy from r group by all""")
def agg19_label_accuracy(s, d):
    v, n = _knn(s, d)
    voted = vec.votes(n, v, "vec_id", "phenotype").join(v.select(F.col("vec_id").alias("query"), "label"), "query")
    right = F.count_if(F.col("y_true") == F.col("y_pred"))
    return voted.groupBy("label", F.col("y_true").alias("phenotype")).agg(F.count("*").alias("total"), right.alias("correct"), F.round(right.cast("double") / F.count("*"), 6).alias("accuracy"))


_EUC = f"""with {V}, x as (select q.vec_id as query, v.vec_id as neighbour, q.label = v.label as same, round(list_distance(q.v, v.v), 9) as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0),
k as (select * from (select *, row_number() over (partition by query order by score, neighbour) as rank from x) where rank <= 9)"""


@query(_EUC + """ select i as k, round(avg(same::int::double), 6) as purity, round(avg(score) filter (where same), 6) as same_distance, round(avg(score) filter (where not same), 6) as other_distance
from k join (select unnest([1, 3, 5, 7, 9])::bigint as i) as n on rank <= i group by 1""")
def met14_purity_by_k(s, d):
    v = vectors(s, d)
    n = vec.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "v", 9, "euclidean")
    return vec.purity_by_k(vec.match_flags(n, v, "vec_id", ["label"]), "same_label", [1, 3, 5, 7, 9])


@query(f"""with {V}, x as (select q.vec_id as query, v.vec_id as neighbour, q.phenotype as own, q.split, v.phenotype as y, round(list_distance(q.v, v.v), 9) as score from v q join v on v.vec_id <> q.vec_id and v.split = 'train' where q.vec_id % 100 = 0),
k as (select * from (select *, row_number() over (partition by query order by score, neighbour) as rank from x) where rank <= 10),
p as (select query, own, split, i as k, weighting, (round(sum(w * y) / sum(w), 9) > 0.5)::int as p from (select *, case weighting when 'uniform' then 1.0::double else 1 / greatest(score, 1e-12::double) end as w from k, (select unnest(['uniform', 'distance']) as weighting))
  join (select unnest([3, 5, 7, 10])::bigint as i) as n on rank <= i group by all)
select k, weighting, split, count(*) as n, round(avg((p = own)::int::double), 6) as accuracy from p group by all""")
def mdl07_neighbour_grid(s, d):
    v = vectors(s, d)
    n = vec.nearest(v.where("vec_id % 100 = 0"), v.where("split = 'train'"), "vec_id", "v", 10, "euclidean")
    return vec.vote_grid(n, v, "vec_id", "phenotype", "split", [3, 5, 7, 10])


@query("""with n as (select lower(trim(genome_id)) as norm, genome_id from (select distinct genome_id from tiny_manifest where genome_id is not null)), k as (select genome_id, """ + _NORM.format("genome_id") + """ as norm from n)
select norm, count(*) as n_ids, string_agg(genome_id, '; ' order by genome_id) as ids from k group by 1 having count(*) > 1""")
def agg21_alike_ids(s, d):
    return rel.alike_ids(table(s, d, "tiny_manifest", ["genome_id"]), "genome_id")


@query(_KNN + " select neighbour, count(*) as n, round(count(*)::double / (select count(*) from k), 6) as share from k group by 1")
def agg18_neighbour_usage(s, d):
    n = _knn(s, d)[1].select("neighbour")
    return rel.value_shares(n, "neighbour")


@query(_KNN + " select q.label, b.label as neighbour_label, count(*) as n from k join v q on q.vec_id = k.query join v b on b.vec_id = k.neighbour group by all")
def agg19_neighbour_labels(s, d):
    v, n = _knn(s, d)
    return n.join(v.select(F.col("vec_id").alias("query"), "label"), "query").join(v.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("neighbour_label")), "neighbour").groupBy("label", "neighbour_label").agg(F.count("*").alias("n"))


@query(_KNN + """ select q.split, round(avg((q.label = b.label)::int::double), 6) as purity from k join v q on q.vec_id = k.query join v b on b.vec_id = k.neighbour where rank <= 5 group by all""")
def met14_neighbour_purity(s, d):
    v, n = _knn(s, d)
    own = v.select(F.col("vec_id").alias("query"), "split", F.col("label").alias("l"))
    return n.where("rank <= 5").join(own, "query").join(v.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy("split").agg(F.round(F.avg((F.col("l") == F.col("label")).cast("double")), 6).alias("purity"))


# ---------------------------------------------------------------- aggregations


@query(f"with {M} select split, count(*) as n_rows, count(distinct species) as n_species from m group by 1")
def agg01_partitions(s, d):
    return rel.summary_by(manifest(s, d), ["split"], "species")


@query(f"with {M} select distinct split, species from m")
def agg03_species_of_split(s, d):
    return manifest(s, d).select("split", "species").distinct()


@query(f"with {M} select distinct split, species from m where split in ('val_outside', 'test_outside') and species in (select species from m where split = 'train')")
def agg04_leakage(s, d):
    return rel.outside_leakage(manifest(s, d))


_RATES = "count(*) filter (where phenotype = 1) as n_resistant, count(*) filter (where phenotype = 0) as n_susceptible, round(100.0::double * count(*) filter (where phenotype = 1) / count(*), 6) as resistant_pct"


@query(f"with {M} select split, {_RATES} from m group by 1")
def agg05_rates(s, d):
    return rel.rates_by(manifest(s, d), ["split"])


@query(f"with {M} select split, species, {_RATES} from m group by all")
def agg06_rates_by_species(s, d):
    return rel.rates_by(manifest(s, d), ["split", "species"])


@query(f"with {M} select species, count(*) as n from m group by 1 order by n desc, species limit 10")
def agg07_top_species(s, d):
    return manifest(s, d).groupBy("species").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species").limit(10)


@query(f"with {M} select split, count(*) as n, round(count(*)::double / (select count(*) from m), 6) as share from m group by 1")
def agg08_shares(s, d):
    return rel.value_shares(manifest(s, d), "split")


def _part(m: DataFrame) -> DataFrame:
    return m.where("row_id % 3 = 0")


@query(f"with {M} select split, count(distinct species) as n_full, count(distinct species) filter (where row_id % 3 = 0) as n_part, round(100.0::double * count(distinct species) filter (where row_id % 3 = 0) / count(distinct species), 6) as coverage_pct from m group by 1")
def agg09_diversity(s, d):
    m = manifest(s, d)
    return sta.coverage_of(m, _part(m), "split", "species")


@query(f"with {M} select source_dataset, " + ", ".join(f"count(*) filter (where split = '{x}') as {x}" for x in SPLIT_GROUP) + " from m group by 1")
def agg10_agg13_by_dataset(s, d):
    return rel.zero_filled(manifest(s, d), "source_dataset", list(SPLIT_GROUP), "split")


@query(f"with {M} select source_dataset, split, count(*) as n from m group by rollup (source_dataset, split)")
def agg11_totals(s, d):
    return manifest(s, d).rollup("source_dataset", "split").agg(F.count("*").alias("n"))


@query(f"with {M} select case when grouping(species) = 1 then 'All' else species end as species, count(*) filter (where phenotype = 0) as phenotype_0, count(*) filter (where phenotype = 1) as phenotype_1, count(*) as \"All\" from m group by rollup (species)")
def agg12_crosstab(s, d):
    return rel.crosstab(manifest(s, d), "species", "phenotype", [0, 1])


@query("select event_type, max(value) as vmax, round(avg(value), 6) as vmean, count(*) as cnt from events group by 1")
def agg15_group_stats(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.max("value").alias("vmax"), F.round(F.avg("value"), 6).alias("vmean"), F.count("*").alias("cnt"))


@query("select t % 4 as layer, " + ", ".join(f"coalesce(max(x) filter (where e = '{e}'), 0) as {e}" for e in ("click", "error", "purchase", "signup", "view")) + " from (select row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as x, event_type as e from events) group by 1")
def agg14_pivot_max(s, d):
    e = numbered(table(s, d, "events", ["user_id", "ts", "event_id", "event_type", "value"]), ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    t = e.select((F.col("t") % 4).alias("layer"), "event_type", "value")
    return t.groupBy("layer").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.max("value")).fillna(0.0)


@query(f"""with {M}, c as (select split, species, count(*) as n from m group by all), r as (select *, row_number() over (partition by split order by n desc, species) as k, count(*) over (partition by split) as kinds from c)
select split, string_agg(species || ' (' || n || ')', '; ' order by k) filter (where k <= 5) as names, greatest(max(kinds) - 5, 0) as n_more from r group by 1""")
def agg16_names(s, d):
    return rel.joined_names(manifest(s, d), ["split"], "species", 5)


@query(f"""with {M}, c as (select species, count(*) filter (where phenotype = 1) as r, count(*) filter (where phenotype = 0) as s from m group by 1)
select species, r + s as n, round(greatest(r, s)::double / (r + s), 6) as purity, case when r > s then 'R' else 'S' end as dominant from c where r + s > 1""")
def agg17_purity(s, d):
    return rel.purity(manifest(s, d), "species")


@query("select count(*) as n_rows, count(distinct genome_id) as n_keys, count(*) - (select count(*) from (select distinct * from kover_labels)) as n_duplicated from kover_labels")
def agg21_duplicates(s, d):
    return rel.duplicates(table(s, d, "kover_labels"), "genome_id")


@query(f"with {M} select split, (2 * sum(phenotype) >= count(*))::int as majority from m group by 1")
def agg26_majority(s, d):
    return manifest(s, d).groupBy("split").agg((2 * F.sum("phenotype") >= F.count("*")).cast("int").alias("majority"))


@query(f"with {M} select species, count(*) as n, round(1.0::double / ((select count(distinct species) from m) * count(*)), 9) as weight from m group by 1")
def agg27_weights(s, d):
    return rel.inverse_weights(manifest(s, d), "species")


@query("""select i as dim, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, round(min(x), 6) as min, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.5), 6) as q50,
  round(quantile_cont(x, 0.75), 6) as q75, round(max(x), 6) as max, count(*) as n from (select unnest(range(64)) as i, unnest(embedding::double[]) as x from embeddings) group by 1""")
def agg24_agg25_describe(s, d):
    return sta.describe(_dims(s, d), ["dim"], "x")


def _dims(s, d):
    return vectors(s, d).select("vec_id", "label", F.posexplode("v").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))


@query(f"""with {M}, c as (select split, antibiotic, count(*) as n from m group by all) select split, antibiotic, n, rank from (select *, row_number() over (partition by split order by n desc, antibiotic) as rank from c) where rank <= 10""")
def lim01_top_antibiotics(s, d):
    return rel.top_per_group_counted(manifest(s, d), ["split"], "antibiotic", 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {M} select genome_id from m union select genome_id from kover_labels where genome_id is not null")
def set05_union(s, d):
    return manifest(s, d).select("genome_id").union(labels(s, d).select("genome_id")).distinct()


@query(f"with {M} select species from m except select species from m where split = 'train'")
def set03_not_in_train(s, d):
    m = manifest(s, d).select("species", "split")
    return m.select("species").subtract(m.where("split = 'train'").select("species"))


@query(f"with {M} select map_from_entries(list((antibiotic, n) order by antibiotic))::varchar as counts, split from (select split, antibiotic, count(*) as n from m group by all) group by split")
def map01_counts(s, d):
    c = manifest(s, d).groupBy("split", "antibiotic").agg(F.count("*").alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("antibiotic", "n"))), lambda x: F.concat(x["antibiotic"], F.lit("="), x["n"].cast("string")))
    return c.groupBy("split").agg(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("counts"))


# ---------------------------------------------------------------- metrics

_C = "count(*) filter (where y_true = 1 and y_pred = 1) as tp, count(*) filter (where y_true = 0 and y_pred = 0) as tn, count(*) filter (where y_true = 0 and y_pred = 1) as fp, count(*) filter (where y_true = 1 and y_pred = 0) as fn"
_SUMMARY = P + f""", c as (select grp, {_C} from p group by 1), r as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as pr, coalesce(tp / nullif(tp + fn, 0), 0)::double as re, coalesce(tn / nullif(tn + fp, 0), 0)::double as sp from c),
s as (select grp, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(pr, 6) as precision, round(re, 6) as recall, round(sp, 6) as specificity, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) as f1,
  round(case when tp + fn = 0 then sp when tn + fp = 0 then re else (re + sp) / 2 end, 6) as balanced_accuracy,
  round(coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) as mcc from r)"""


@query(f"with {_SUMMARY} select * from s")
def met01_met07_summary(s, d):
    return met.classification_summary(predictions(s, d), ["grp"])


@query(f"with {_SUMMARY} select grp, 'f1' as metric, f1 as value from s union all select grp, 'mcc', mcc from s")
def met16_long(s, d):
    return met.long_results(met.classification_summary(predictions(s, d), ["grp"]), ["grp"], ["f1", "mcc"])


_RANK = P + """, k as (select grp, y_true, y_score, rank() over (partition by grp order by y_score) + (count(*) over (partition by grp, y_score) - 1) / 2 as r from p),
a as (select grp, sum(y_true) as np, count(*) - sum(y_true) as nn, sum(case when y_true = 1 then r end) as rs from k group by 1),
st as (select grp, y_score, sum(y_true) as dp, count(*) as dn from p group by all), cu as (select *, sum(dp) over w as tp, sum(dn) over w as all_n, sum(dp) over (partition by grp) as pos from st window w as (partition by grp order by y_score desc rows unbounded preceding))"""


@query(f"with {_RANK} select a.grp, case when np > 0 and nn > 0 then round((rs - np * (np + 1) / 2) / (np::double * nn), 6) end as auroc, case when np > 0 and nn > 0 then (select round(sum(dp::double / pos * tp / all_n), 6) from cu where cu.grp = a.grp) end as auprc from a")
def met08_met09_ranking(s, d):
    return met.ranking_summary(predictions(s, d), ["grp"])


@query(f"""with {P}, th as (select unnest(range(100)) as i), c as (select grp, i, count(*) filter (where y_true = 1 and y_score + 1e-14 >= i / 99.0::double) as tp, count(*) filter (where y_true = 0 and y_score + 1e-14 >= i / 99.0::double) as fp,
  count(*) filter (where y_true = 1 and y_score + 1e-14 < i / 99.0::double) as fn, count(*) filter (where y_true = 0 and y_score + 1e-14 < i / 99.0::double) as tn from p, th group by all),
k as (select grp, i, round(coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) as mcc from c)
select grp, round(i / 99.0::double, 6) as threshold, round(mcc, 6) as mcc from (select *, row_number() over (partition by grp order by mcc desc, i) as r from k) where r = 1""")
def met10_threshold(s, d):
    return met.best_threshold(predictions(s, d), ["grp"])


@query(f"""with {P}, st as (select grp, y_score, sum(y_true) as dp, count(*) - sum(y_true) as dn from p group by all)
select grp, round(y_score, 6) as y_score, cast(sum(dp) over w as bigint) as tp, cast(sum(dn) over w as bigint) as fp from st window w as (partition by grp order by y_score desc rows unbounded preceding)""")
def met11_curve(s, d):
    return met.score_steps(predictions(s, d), ["grp"]).select("grp", F.round("y_score", 6).alias("y_score"), "tp", "fp")


@query(f"with {P} select row_id, round(1 / (1 + exp(-y_score)), 6) as p from p")
def met12_sigmoid(s, d):
    return predictions(s, d).select("row_id", F.round(1 / (1 + F.exp(-F.col("y_score"))), 6).alias("p"))


@query(f"""with {M}, c as (select species, phenotype, count(*)::double as n from m group by all), a as (select sum(n * (n - 1) / 2) as x from (select sum(n) as n from c group by species)), b as (select sum(n * (n - 1) / 2) as y from (select sum(n) as n from c group by phenotype)),
t as (select sum(n) as n, sum(n * (n - 1) / 2) as pairs from c) select round((pairs - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) as ari from t, a, b""")
def met15_adjusted_rand(s, d):
    return met.adjusted_rand(manifest(s, d), "species", "phenotype")


# ---------------------------------------------------------------- statistics


@query(f"""with {M} select a.split, round(a.r, 6) as rate_full, round(coalesce(b.r, 0), 6) as rate_part, round(coalesce(b.r, 0) - a.r, 6) as difference from (select split, avg(phenotype::double) as r from m group by 1) a left join
(select split, avg(phenotype::double) as r from m where row_id % 3 = 0 group by 1) b using (split)""")
def sta01_rate_comparison(s, d):
    m = manifest(s, d)
    return sta.rate_comparison(m, _part(m), "split")


@query(f"""with {M}, c as (select (row_id % 3 = 0)::int as g, phenotype as y, count(*)::double as n from m group by all), e as (select g, y, n, sum(n) over (partition by g) * sum(n) over (partition by y) / sum(n) over () as e, sum(n) over () as t from c),
x as (select sum(power(greatest(abs(n - e) - 0.5, 0), 2) / e) as x, max(t)::bigint as n from e), z as (select x, n, sqrt(x / 2) as z, 1 / (1 + sqrt(x / 2) / 2) as t from x),
p as (select x, n, t * exp(-z * z - 1.26551223::double + t * (1.00002368::double + t * (0.37409196::double + t * (0.09678418::double + t * (-0.18628806::double + t * (0.27886807::double + t * (-1.13520398::double + t * (1.48851587::double + t * (-0.82215223::double + t * 0.17087277::double))))))))) as p from z)
select round(x, 6) as chi2, n, round(p, 5) as p_value, p < 0.05 as significant from p""")
def sta02_chi_square(s, d):
    return sta.chi_square_yates(manifest(s, d).withColumn("g", F.col("row_id") % 3 == 0), "g", "phenotype")


@query("select event_type, round(quantile_cont(abs(value), 0.95), 6) as p0_95, round(quantile_cont(abs(value), 0.99), 6) as p0_99, round(quantile_cont(abs(value), 0.999), 6) as p0_999, round(quantile_cont(abs(value), 0.9999), 6) as p0_9999 from events group by 1")
def sta08_percentiles(s, d):
    return sta.percentiles(table(s, d, "events").withColumn("a", F.abs("value")), ["event_type"], "a", [0.95, 0.99, 0.999, 0.9999])


@query(f"with {T}, c as (select user_id, avg(x) as a, greatest(stddev_samp(x), 1e-6) as s from t group by 1) select user_id, round(max(abs((x - a) / s)), 6) as max_z, round(avg((abs((x - a) / s) > 3)::int::double), 6) as frac_z from t join c using (user_id) group by 1")
def sta09_zscores(s, d):
    return sta.zscore_extremes(tokens(s, d), ["user_id"], "x", 3.0)


@query(f"""with {T}, k as (select *, abs(x) as a, row_number() over (partition by user_id order by abs(x) desc, t) as r from t)
select user_id, round(avg(a), 6) as mean, round(stddev_samp(a), 6) as std, round(max(a), 6) as max, round(avg(a) filter (where r <= 10), 6) as top_mean, min(t) filter (where r = 1) as argmax_t from k group by 1""")
def sta10_sta11_token_norms(s, d):
    return sta.token_norms(tokens(s, d), ["user_id"], "x")


@query("with m as (select event_type as e, avg(value) as a from events group by 1) select event_type, round(avg(power(value - a, 4)) / (power(avg(power(value - a, 2)), 2) + 1e-12), 6) as kurtosis from events join m on e = event_type group by 1")
def sta12_kurtosis(s, d):
    return sta.kurtosis_of(table(s, d, "events", ["event_type", "value"]), ["event_type"], "value")


@query("""with x as (select event_type, abs(value) as x from events where abs(value) > 0), r as (select *, row_number() over (partition by event_type order by x desc) as r, count(*) over (partition by event_type) as n from x)
select event_type, round(1 / (avg(ln(x)) - ln(min(x))), 6) as hill from r where r <= 50 group by 1""")
def sta13_hill(s, d):
    return sta.hill_index(table(s, d, "events", ["event_type", "value"]), ["event_type"], "value", 50)


@query("select least(floor(l_quantity / 2.5), 19)::int as bin, count(*) as n, round(count(*) / (sum(count(*)) over () * 2.5::double), 9) as density from lineitem where l_quantity between 0 and 50 group by 1")
def vec12_histogram(s, d):
    return sta.histogram(table(s, d, "lineitem", ["l_quantity"]).withColumn("l_quantity", F.col("l_quantity").cast("double")), "l_quantity", 0.0, 50.0, 20)


# ---------------------------------------------------------------- sampling and splits


@query(f"with {M}, g as (select distinct split, genome_id from m) select split, genome_id from (select *, row_number() over (partition by split order by md5(genome_id || ':42'), genome_id) as r from g) where r <= 20")
def smp01_hash_sample(s, d):
    return rel.sample_per_group(manifest(s, d).select("split", "genome_id").distinct(), ["split"], "genome_id", 20)


@query(f"""with {M}, g as (select distinct genome_id, phenotype from m where split = 'train' and antibiotic = 'velocillin'), r as (select *, row_number() over (partition by phenotype order by md5(genome_id || ':42'), genome_id) as r from g),
z as (select * from r where phenotype = 0 and r <= 35) select genome_id, phenotype from z union all select genome_id, phenotype from r where phenotype = 1 and r <= 100 - (select count(*) from z)""")
def smp02_balanced(s, d):
    g = manifest(s, d).where("split = 'train' and antibiotic = 'velocillin'").select("genome_id", "phenotype").distinct()
    return rel.sample_balanced(g, "phenotype", "genome_id", 100, 0.35)


@query(f"""with {M}, g as (select distinct split, antibiotic, genome_id, phenotype from m), r as (select *, row_number() over (partition by split, antibiotic, phenotype order by md5(genome_id || ':42'), genome_id) as r from g),
z as (select split, antibiotic, count(*) filter (where phenotype = 0 and r <= 35) as n from r group by all)
select split, antibiotic, genome_id, phenotype from r join z using (split, antibiotic) where r <= case when phenotype = 0 then n else 100 - n end""")
def smp02_balanced_by_drug(s, d):
    g = manifest(s, d).select("split", "antibiotic", "genome_id", "phenotype").distinct()
    return rel.sample_balanced(g, "phenotype", "genome_id", 100, 0.35, by=["split", "antibiotic"])


_PLANNED = {"train": (200, 0.35), "val_overlapped": (60, 0.5), "test_overlapped": (60, 0.5), "val_outside": (50, 0.4), "test_outside": (50, 0.4)}
_PLAN = f"""with {M}, g as (select distinct split, genome_id, phenotype from m where antibiotic = 'velocillin'), c as (select split, count(*) filter (where phenotype = 0) as z, count(*) filter (where phenotype = 1) as o from g group by 1),
q(split, target, share) as (values {", ".join(f"('{s}', {n}, {x}::decimal(12,6))" for s, (n, x) in _PLANNED.items())}),
n as (select q.split, target, coalesce(z, 0) as there_zero, coalesce(o, 0) as there_one, least(coalesce(z, 0), floor(target * share)::bigint) as n_zero from q left join c using (split)),
plan as (select split, there_zero, there_one, n_zero, least(there_one, target - n_zero)::bigint as n_one from n)"""


def _plan(s, d):
    g = manifest(s, d).where("antibiotic = 'velocillin'").select("split", "genome_id", "phenotype").distinct()
    targets = s.createDataFrame([(k, n, x) for k, (n, x) in _PLANNED.items()], "split string, target long, share_of_zero double")
    return g, rel.quota_plan(g, "split", "phenotype", targets)


@query(_PLAN + " select * from plan")
def smp03_quota_plan(s, d):
    return _plan(s, d)[1]


@query(_PLAN + " select split, 0 as phenotype, n_zero as n_drawn from plan where n_zero > 0 union all select split, 1, n_one from plan where n_one > 0")
def smp03_smp04_drawn(s, d):
    g, plan = _plan(s, d)
    return rel.sample_planned(g, "split", "phenotype", "genome_id", plan).groupBy("split", "phenotype").agg(F.count_distinct("genome_id").alias("n_drawn"))


_DRUG_PLAN = f"""with {M}, g as (select distinct split, antibiotic, genome_id, phenotype from m), c as (select split, antibiotic, count(*) filter (where phenotype = 0) as z, count(*) filter (where phenotype = 1) as o from g group by all),
q(split, target, share) as (values {", ".join(f"('{s}', {n}, {x}::decimal(12,6))" for s, (n, x) in _PLANNED.items())}), drugs as (select distinct antibiotic from m),
n as (select antibiotic, q.split, target, coalesce(z, 0) as there_zero, coalesce(o, 0) as there_one, least(coalesce(z, 0), floor(target * share)::bigint) as n_zero from drugs cross join q left join c using (split, antibiotic)),
plan as (select antibiotic, split, there_zero, there_one, n_zero, least(there_one, target - n_zero)::bigint as n_one from n)"""


def _drug_plan(s, d):
    g = manifest(s, d).select("antibiotic", "split", "genome_id", "phenotype").distinct()
    wanted = F.inline(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(n).cast("long").alias("target"), F.lit(x).alias("share_of_zero")) for k, (n, x) in _PLANNED.items()]))
    return g, rel.quota_plan(g, ["antibiotic", "split"], "phenotype", g.select("antibiotic").distinct().select("antibiotic", wanted))


@query(_DRUG_PLAN + " select * from plan")
def smp03_plan_by_drug(s, d):
    return _drug_plan(s, d)[1]


@query(_DRUG_PLAN + " select antibiotic, split, 0 as phenotype, n_zero as n_drawn from plan where n_zero > 0 union all select antibiotic, split, 1, n_one from plan where n_one > 0")
def smp03_smp04_drawn_by_drug(s, d):
    g, plan = _drug_plan(s, d)
    return rel.sample_planned(g, ["antibiotic", "split"], "phenotype", "genome_id", plan).groupBy("antibiotic", "split", "phenotype").agg(F.count_distinct("genome_id").alias("n_drawn"))


@query(f"with {M}, g as (select distinct species, genome_id from m where split = 'train') select species, genome_id from (select *, row_number() over (partition by species order by md5(genome_id || ':7'), genome_id) as r from g) where r <= 2")
def smp05_per_species(s, d):
    return rel.sample_per_group(manifest(s, d).where("split = 'train'").select("species", "genome_id").distinct(), ["species"], "genome_id", 2, 7)


@query(f"with {T}, h as (select *, row_number() over (partition by user_id order by md5(t::varchar || ':42'), t) as r from t) select user_id, t, x from h where r <= 16")
def smp08_row_sample(s, d):
    return rel.sample_per_group(tokens(s, d), ["user_id"], "t", 16)


@query(f"with {M} select genome_id, 'next_round' as subset_name, (select max(extraction_round) + 1 from used_registry) as extraction_round from (select distinct genome_id from m where split = 'train') where genome_id not in (select genome_id from used_registry where genome_id is not null)")
def smp13_next_round(s, d):
    return rel.registry_rounds(manifest(s, d).where("split = 'train'"), table(s, d, "used_registry"), "genome_id", "next_round")


@query(f"with {M}, g as (select distinct genome_id from m), h as (select genome_id, ('0x' || substr(md5(genome_id || ':42'), 1, 6))::bigint as b from g) select genome_id, case when b < floor(0.1 * 16777216) then 'val' when b < floor(0.2 * 16777216) then 'test' else 'train' end as assigned from h")
def spl01_hash_split(s, d):
    return rel.hash_split(manifest(s, d).select("genome_id").distinct(), "genome_id", {"val": 0.1, "test": 0.1})


@query(f"with {M} select distinct genome_id, case when species in ('brulospira_miraris') then 'validation' when species in ('quorella_solentis') then 'test' else 'train' end as assigned from m")
def spl03_species_holdout(s, d):
    return rel.species_holdout(manifest(s, d), ["quorella_solentis"], ["brulospira_miraris"]).select("genome_id", "assigned").distinct()


@query(f"with {M} select row_id, phenotype, ((row_number() over (partition by phenotype order by md5(row_id || ':42'), row_id) - 1) % 5)::int as fold from m")
def spl05_folds(s, d):
    return rel.stratified_folds(manifest(s, d).select("row_id", "phenotype"), "phenotype", "row_id", 5)


@query(f"with {M}, r as (select row_id, phenotype, unnest(range(2))::int as repeat from m) select row_id, phenotype, repeat, ((row_number() over (partition by repeat, phenotype order by md5(row_id || ':' || (repeat + 42)), row_id) - 1) % 5)::int as fold from r")
def spl05_repeated_folds(s, d):
    return rel.repeated_folds(manifest(s, d).select("row_id", "phenotype"), "phenotype", "row_id", 5, 2)


# ---------------------------------------------------------------- windows and vectors

_SPANS = """n as (select user_id, count(*) as n from events group by 1), sp as (select user_id, n, unnest(case when n < 16 then [[0, n]] else list_concat(list_transform(range((n - 16) // 8 + 1), lambda i: [i * 8, i * 8 + 16]),
  case when (n - 16) % 8 <> 0 then [[n - 16, n]] else [] end) end) as w from n), sw as (select user_id, row_number() over (partition by user_id order by w[1]) - 1 as window_idx, w[1] as start, w[2] as "end" from sp)"""


@query(f'with {_SPANS} select user_id, start, "end" from sw')
def win01_spans(s, d):
    n = table(s, d, "events", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.inline(seq.spans(F.col("n"), 16, 8)))


@query(f'with {T}, {_SPANS} select sw.user_id, window_idx, start, "end", round(sqrt(sum(x * x)), 6) as norm, count(*) as n from sw join t on t.user_id = sw.user_id and t.t >= start and t.t < "end" group by all')
def win05_window_norms(s, d):
    return seq.windows_of(tokens(s, d), "user_id", 16, 8).groupBy("user_id", "window_idx", "start", "end").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.count("*").alias("n"))


@query(f"with {T}, n as (select user_id, max(t) + 1 as n from t group by 1), b as (select user_id, case when n <= 1 then 0 else floor(t / (n - 1)::double * (1 - 1e-9::double) * 20) end::int as bin, avg(x) as a from t join n using (user_id) group by all) select bin, round(avg(a), 6) as mean, count(*) as n_sequences from b group by 1")
def win04_position_bins(s, d):
    return seq.position_bins(tokens(s, d), "user_id", "x", 20)


@query(f"with {V} select label, i as dim, round(avg(v[i + 1]), 6) as mean from v, range(64) r(i) group by all")
def vec01_mean_pool(s, d):
    return seq.mean_pool(vectors(s, d), ["label"], "v", 64).select("label", F.posexplode("pooled").alias("dim", "m")).select("label", F.col("dim").cast("long").alias("dim"), F.round("m", 6).alias("mean"))


_SIX = "round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(max(x), 6) as max, round(min(x), 6) as min, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.75), 6) as q75"


@query(f"with {T} select user_id, {_SIX} from t group by 1")
def vec02_six_stats(s, d):
    return seq.six_stats(tokens(s, d), ["user_id"], "x")


@query(f"with {T}, r as (select *, row_number() over (partition by user_id order by x desc) as r, count(*) over (partition by user_id) as n from t) select user_id, round(avg(x), 6) as top_k_mean from r where r <= 8 and n >= 8 group by 1")
def vec04_top_k_mean(s, d):
    return seq.top_k_mean(tokens(s, d), ["user_id"], "x", 8)


@query(f"with {V} select vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) as total from v")
def vec07_l2(s, d):
    return vectors(s, d).select("vec_id", F.round(F.aggregate(sc.l2_normalised(F.col("v")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {V} select vec_id, round(list_max(list_transform(v, lambda x: (greatest(least(x, 0.2), -0.2) - list_avg(list_transform(v, lambda y: greatest(least(y, 0.2), -0.2)))) / sqrt(list_var_pop(list_transform(v, lambda y: greatest(least(y, 0.2), -0.2))) + 1e-5))), 6) as top from v")
def vec08_clip_layer_norm(s, d):
    return vectors(s, d).select("vec_id", F.round(F.array_max(sc.layer_normalised(sc.clipped(F.col("v"), -0.2, 0.2))), 6).alias("top"))


@query(f"with {T}, c as (select user_id, avg(x) as a, stddev_pop(x) as s from t group by 1) select user_id, t, round((x - a) / (s + 1e-8), 6) as z from t join c using (user_id)")
def vec09_zscore(s, d):
    return seq.zscored(tokens(s, d), ["user_id"], "x").select("user_id", "t", F.round("z", 6).alias("z"))


@query(f"with {V} select dim, round(var_pop(x), 9) as variance from (select unnest(range(64)) as dim, unnest(v) as x from v) group by 1 order by variance desc, dim limit 20")
def vec10_top_variance(s, d):
    return _dims(s, d).groupBy("dim").agg(F.round(F.var_pop("x"), 9).alias("variance")).orderBy(F.desc("variance"), "dim").limit(20)


@query(f"with {V} select i::int as i, j::int as j, round(covar_samp(v[i + 1], v[j + 1]), 6) as cov from v, range(64) a(i), range(64) b(j) group by all")
def prj01_covariance(s, d):
    return vec.covariance(vectors(s, d), "v", 64).withColumn("cov", F.round("cov", 6))


@query()
def prj02_pca_projection(s, d):
    v = vectors(s, d)
    mean, axes, _ = vec.principal_axes(v.where("split = 'train'"), "v", 64, 3)
    return vec.projected(v, "v", mean, axes).select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


_RP = """e as (select i, j, ('0x' || substr(md5('42:' || i || ':' || j), 1, 6))::bigint / 16777216.0::double as u from range(8) a(i), range(64) b(j)),
w as (select i, j, case when u >= 0.125 then 0 when u < 0.0625 then 1 / sqrt(0.125::double * 8) else -1 / sqrt(0.125::double * 8) end as w from e)"""


@query(f"with {V}, {_RP} select vec_id, i, round(sum(v[j + 1] * w), 6) as x from v, w group by all")
def prj04_prj05_random_projection(s, d):
    import numpy as np

    p = vec.projected(vectors(s, d), "v", np.zeros(64), vec.sparse_axes(64, 8))
    return p.select("vec_id", F.posexplode("projected").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query()
def prj06_kernel_features(s, d):
    windows = seq.windows_of(tokens(s, d), "user_id", 64, 32)
    return vec.kernel_features(windows, ["user_id", "window_idx"], "x", 64).select("user_id", "window_idx", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def _token_vectors(s, d):
    """The vectors of a label as the tokens of one sequence, in the order of their ids."""
    return numbered(vectors(s, d).select("label", "vec_id", "v"), ["label"], ["vec_id"], F.floor(F.col("vec_id") / 100_000))


@query()
def prj06_multichannel_features(s, d):
    windows = seq.windows_of(_token_vectors(s, d), "label", 32, 16)
    return vec.kernel_features(windows, ["label", "window_idx"], "v", 32, channels=64).select("label", "window_idx", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


_ABOVE = 0.123456  # a bias that no sum of rounded values meets


@query(f"""with {T}, n as (select user_id, count(*) as n from t group by 1), ds as (select unnest([1, 2, 4]) as d), ks as (select a, b, c from range(9) x(a), range(9) y(b), range(9) z(c) where a < b and b < c),
taps as (select t.user_id, d, t.t, j, coalesce(o.x, 0) as x from t, ds, range(9) g(j) left join t o on o.user_id = t.user_id and o.t = t.t + d * (j - 4)),
rows as (select user_id, d, t, list(x order by j) as w, sum(x) as all_x from taps group by all)
select user_id, d as dilation, '' || a || b || c as kernel, round(avg((3 * (w[a + 1] + w[b + 1] + w[c + 1]) - all_x > {_ABOVE})::int::double), 6) as share from rows, ks group by all""")
def prj06_positive_shares(s, d):
    return vec.positive_shares_above(tokens(s, d), ["user_id"], "x", [1, 2, 4], _ABOVE)


@query()
def prj10_variance_curve(s, d):
    import numpy as np

    share = vec.principal_axes(vectors(s, d), "v", 64, 64)[2]
    return s.createDataFrame([(i + 1, round(float(x), 6), round(float(c), 6)) for i, (x, c) in enumerate(zip(share, np.cumsum(share)))], "k int, share double, cumulative double")


@query()
def sta06_spectrum(s, d):
    return vec.spectrum_stats(vectors(s, d), "label", "v").select("label", "n", F.round("effective_rank", 4).alias("effective_rank"), F.round("participation_ratio", 4).alias("participation_ratio"))


@query(f"""with {V}, u as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from v), m as (select label, j, avg(u[j + 1]) as m from u, range(64) r(j) group by all),
l as (select label, list(m order by j) as m from m group by 1) select label, round(1 - avg(abs(list_dot_product(u, m))), 6) as isotropy, round(any_value(list_dot_product(m, m)), 6) as cos_mean from u join l using (label) group by 1""")
def sta07_isotropy(s, d):
    u = vectors(s, d).withColumn("u", sc.l2_normalised(F.col("v")))
    m = seq.mean_pool(u, ["label"], "u", 64)
    return u.join(m, "label").groupBy("label").agg(F.round(1 - F.avg(F.abs(sc.dot(F.col("u"), F.col("pooled")))), 6).alias("isotropy"), F.round(F.first(sc.dot(F.col("pooled"), F.col("pooled"))), 6).alias("cos_mean"))


# ---------------------------------------------------------------- scalar functions


@query("select row_id, case when lower(trim(r)) in ('1', 'r', 'resistant', 'resistance', 'non-susceptible', 'nonsusceptible') then 1 when lower(trim(r)) in ('0', 's', 'susceptible', 'sensitive') then 0 end as phenotype from (select row_id, case phenotype when 1 then 'Resistant' when 0 then ' s ' when 2 then 'Intermediate' end as r from tiny_manifest)")
def str01_phenotypes(s, d):
    raw = F.expr("case phenotype when 1 then 'Resistant' when 0 then ' s ' when 2 then 'Intermediate' end")
    return table(s, d, "tiny_manifest", ["row_id", "phenotype"]).select("row_id", sc.phenotype_of_text(raw).alias("phenotype"))


@query(f"select distinct genome_id, {_NORM.format('genome_id')} as norm, case when contains(genome_id, '.') then split_part(genome_id, '.', 1) else left(genome_id, 10) end as taxon from (select genome_id from tiny_manifest union all select species from tiny_manifest)")
def str02_str04_ids(s, d):
    m = table(s, d, "tiny_manifest", ["genome_id", "species"])
    ids = m.select("genome_id").union(m.select("species"))  # names without a dot, too
    return ids.select("genome_id", sc.comparable_id(F.col("genome_id")).alias("norm"), sc.taxon_of(F.col("genome_id")).alias("taxon")).distinct()


@query("select distinct sequence_path, case when length(sequence_path) > 30 then left(sequence_path, 27) || '...' else sequence_path end as short from sequences")
def str06_shortened(s, d):
    return table(s, d, "sequences", ["sequence_path"]).select("sequence_path", sc.shortened(F.col("sequence_path"), 30).alias("short")).distinct()


@query("""with b as (select row_id, species, hex(encode(species)) as h from tiny_manifest where species is not null), c as (select row_id, list_transform(range(length(h) // 2), lambda i: ('0x' || h[i * 2 + 1:i * 2 + 2])::bigint) as c from b)
select row_id, coalesce(list_sum(c), 0)::bigint as total, len(c)::bigint as n_bytes, list_resize(c, 32, 0)[1:32] as padded from c""")
def str08_str09_tokens(s, d):
    b = table(s, d, "tiny_manifest", ["row_id", "species"]).where("species is not null").withColumn("b", sc.byte_tokens(F.col("species")))
    return b.select("row_id", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("b").cast("long").alias("n_bytes"), sc.padded(F.col("b"), 32).cast("array<long>").alias("padded"))


# ---------------------------------------------------------------- models


@query()
def mdl01_mdl09_suite(s, d):
    return models.evaluate_suite(vectors(s, d), "v", "phenotype", "split", 64)


@query(f"""with {V}, c as (select phenotype, j, avg(v[j + 1]) as m from v, range(64) r(j) where split = 'train' group by all), l as (select phenotype as c, list(m order by j) as m from c group by 1),
x as (select v.vec_id, l.c, round(list_distance(v.v, l.m), 9) as dist from v, l) select vec_id, c as y_pred from (select *, row_number() over (partition by vec_id order by dist, c) as r from x) where r = 1""")
def mdl07_nearest_centroid(s, d):
    return models.nearest_centroid(vectors(s, d), "vec_id", "v", "phenotype", 64)


@query(f"""with {V}, w as (select vec_id, label, exp(v[1] * 4) as e, v[2] as x from v) select label, round(sum(e * x) / sum(e), 6) as pooled from w group by 1""")
def mdl10_attention_pool(s, d):
    v = vectors(s, d).select("label", (F.get("v", F.lit(0)) * 4).alias("a"), F.get("v", F.lit(1)).alias("x"))
    return models.attention_pool(v, ["label"], "a", "x")


def _bags(s, d):
    """Four vectors a bag; a bag is positive if one of them has label 3."""
    v = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("bag"), "label", sc.doubles(F.col("embedding")).alias("v"))
    y = v.groupBy("bag").agg(F.max((F.col("label") == 3).cast("int")).alias("y"))
    return v.join(y, "bag").withColumn("split", F.when(F.col("bag") % 5 == 0, "test").otherwise("train"))


@query()
def mdl10_attention_training(s, d):
    b = _bags(s, d)
    net = models.train_attention(b.where("split = 'train'"), "bag", "v", "y", 64)
    known = b.select("bag", "split", F.col("y").alias("y_true")).distinct()
    return known.join(models.bag_scores(net, b, "bag", "v"), "bag").select("bag", "split", "y_true", (F.col("logit") > 0).cast("int").alias("y_pred"), F.round(1 / (1 + F.exp(-F.col("logit"))), 6).alias("y_score"))


@query()
def mdl14_cross_validation(s, d):
    v = vectors(s, d).withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(5)))
    chosen = {n: m for n, m in models.suite(64).items() if n in ("logistic_l2", "calibrated_svm")}
    return models.cross_validated(v, "v", "phenotype", "fold", 5, chosen)


@query(f"""with {V}, f as (select *, (vec_id // 100) % 5 as fold from v), x as (select q.vec_id as query, v.vec_id as neighbour, q.phenotype as own, q.fold, v.phenotype as y, round(list_distance(q.v, v.v), 9) as score from f q join f v on q.fold <> v.fold where q.vec_id % 100 = 0),
k as (select * from (select *, row_number() over (partition by query order by score, neighbour) as rank from x) where rank <= 5),
p as (select query, own, fold, weighting, (round(sum(w * y) / sum(w), 9) > 0.5)::int as p from (select *, case weighting when 'uniform' then 1.0::double else 1 / greatest(score, 1e-12::double) end as w from k, (select unnest(['uniform', 'distance']) as weighting)) group by all)
select 5::bigint as k, weighting, fold, count(*) as n, round(avg((p = own)::int::double), 6) as accuracy from p group by all""")
def mdl14_neighbour_folds(s, d):
    v = vectors(s, d).withColumn("fold", F.floor(F.col("vec_id") / 100) % 5)
    n = vec.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "v", 5, "euclidean", apart="fold")
    return vec.vote_grid(n, v, "vec_id", "phenotype", "fold", [5]).withColumnRenamed("split", "fold")


@query(f"""with {V}, x as (select q.vec_id as query, q.label, v.label as c, sum(list_distance(q.v, v.v)) as total, count(*) as n from v q, v where q.vec_id % 100 = 0 group by all),
y as (select query, label, max(total / (n - 1)) filter (where c = label and n > 1) as a, min(total / n) filter (where c <> label) as b from x group by all)
select query, label, round(coalesce((b - a) / greatest(a, b), 0), 6) as silhouette from y""")
def met15_silhouette(s, d):
    v = vectors(s, d)
    return vec.silhouettes(v.where("vec_id % 100 = 0"), v, "vec_id", "v", "label").withColumn("silhouette", F.round("silhouette", 6))


@query()
def met15_best_k(s, d):
    return models.best_cluster_count(vectors(s, d), "vec_id", "v", "label", F.col("vec_id") % 100 == 0, range(2, 8))


# ---------------------------------------------------------------- further audits, samples and projections


@query(f"""with {M}, f as (select split, avg(phenotype::double) as r, count(*)::double / (select count(*) from m) as share from m group by 1),
p as (select split, avg(phenotype::double) as r, count(*)::double / (select count(*) from m where row_id % 3 = 0) as share from m where row_id % 3 = 0 group by 1),
c as (select count(distinct species) filter (where row_id % 3 = 0)::double / count(distinct species) as c from m)
select round(100 * (sum(greatest(20.0::double * (1 - abs(round(coalesce(p.r, 0) - f.r, 6))), 0)) + 20.0::double * (1 - avg(abs(round(f.share, 6) - round(p.share, 6)))) + 20.0::double * least(any_value(c), 1)) / 140.0::double, 6) as score
from f join p using (split), c""")
def sta03_representation(s, d):
    m = manifest(s, d)
    covered = m.agg((F.count_distinct(F.when(F.col("row_id") % 3 == 0, F.col("species"))).cast("double") / F.count_distinct("species")).alias("c")).scalar()
    return sta.representation_score(sta.rate_comparison(m, _part(m), "split"), rel.value_shares(m, "split"), rel.value_shares(_part(m), "split"), "split", covered)


_STAGES = ["view", "click", "signup", "purchase"]
_STAGE = """max(case when stage = '{0}' then round(m, 6) end) as {0}_mean, max(case when stage = '{0}' then round(x, 6) end) as {0}_max, max(case when stage = '{0}' then round(tail, 6) end) as {0}_tail"""


@query(f"""with g as (select user_id % 8 as layer, event_type as stage, avg(abs(value)) as m, max(abs(value)) as x, quantile_cont(abs(value), [0.95, 0.99, 0.999]) as p, count(value) as n from events group by all),
t as (select *, case when n < 1000 then p[2] else p[3] end / nullif(p[1], 0) as tail from g)
select layer, {", ".join(_STAGE.format(x) for x in _STAGES)}, round(max(case when stage = 'purchase' then m end) / (max(case when stage = 'view' then m end) + 1e-12), 6) as gain_mean,
  round(max(case when stage = 'purchase' then x end) / (max(case when stage = 'view' then x end) + 1e-12), 6) as gain_max from t group by 1""")
def sta15_decomposition(s, d):
    e = table(s, d, "events", ["user_id", "event_type", "value"]).withColumn("layer", F.col("user_id") % 8)
    return sta.stage_decomposition(e, "layer", "event_type", "value", _STAGES)


@query("select layer, user_id, event_id, x, r as rank from (select user_id % 8 as layer, user_id, event_id, round(abs(value), 6) as x, row_number() over (partition by user_id % 8 order by abs(value) desc, event_id) as r from events) where r <= 5")
def sta16_culprits(s, d):
    e = table(s, d, "events", ["user_id", "event_id", "value"]).select((F.col("user_id") % 8).alias("layer"), "user_id", "event_id", F.abs("value").alias("a"))
    top = rel.top_per_group(e, ["layer"], [F.desc("a"), F.col("event_id")], 5)
    return top.select("layer", "user_id", "event_id", F.round("a", 6).alias("x"), F.col("rank").cast("long").alias("rank"))


@query(f"with {T} select user_id, round(max(abs(x)), 6) as max_padded, max(abs(x)) > 1e-6 as leaks from t where t % 5 = 0 group by 1")
def sta19_mask_leak(s, d):
    return sta.mask_leak(tokens(s, d), ["user_id"], F.col("t") % 5 != 0, "x")


@query(f"""with {M}, g as (select distinct split, genome_id, phenotype from m), c as (select split, count(*) filter (where phenotype = 1) as r, count(*) filter (where phenotype = 0) as z from g group by 1),
a as (select *, case when r + z <= 30 then r else least(floor(30 * r / (r + z)), r) end as q1, case when r + z <= 30 then z else least(30 - floor(30 * r / (r + z)), z) end as q0 from c),
b as (select split, q1 + least(r - q1, greatest(30 - q1 - q0, 0)) as q1, q0 + least(z - q0, greatest(30 - q1 - q0, 0)) as q0 from a),
k as (select *, row_number() over (partition by split, phenotype order by md5(genome_id || ':42'), genome_id) as n from g)
select k.split, genome_id, phenotype from k join b using (split) where n <= case when phenotype = 1 then q1 else q0 end""")
def smp06_proportional(s, d):
    return rel.sample_proportional(manifest(s, d).select("split", "genome_id", "phenotype").distinct(), ["split"], "phenotype", "genome_id", 30)


@query(f"with {M}, g as (select distinct phenotype, genome_id from m join sequences using (sequence_path) where split = 'train') select phenotype, genome_id from (select *, row_number() over (partition by phenotype order by md5(genome_id || ':1337'), genome_id) as r from g) where r <= 30")
def smp07_fit_manifest(s, d):
    there = manifest(s, d).where("split = 'train'").join(table(s, d, "sequences", ["sequence_path"]), "sequence_path", "left_semi")
    return rel.sample_per_group(there.select("phenotype", "genome_id").distinct(), ["phenotype"], "genome_id", 30, 1337)


@query(f"with {T}, n as (select user_id, max(t) + 1 as n from t group by 1), i as (select distinct user_id, floor(i * (n - 1) / 9.0::double)::bigint as t from n, range(10) r(i)) select user_id, t, x from t join i using (user_id, t)")
def smp09_even_sample(s, d):
    return seq.even_rows(tokens(s, d), "user_id", 10)


@query(f'with {_SPANS}, h as (select user_id, start, "end", row_number() over (partition by user_id order by md5(start || \':42\'), start) as r from sw) select user_id, start, "end" from h where r <= 3')
def smp10_window_sample(s, d):
    n = table(s, d, "events", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))
    spans = n.select("user_id", F.inline(seq.spans(F.col("n"), 16, 8)))
    return rel.sample_per_group(spans, ["user_id"], "start", 3)


_SEQ = "s as (select sequence_path, upper(regexp_replace(array_to_string(list_filter(string_split_regex(fasta, '[\\r\\n]+'), lambda x: not starts_with(x, '>')), ''), '[ \\t]', '', 'g')) as q from sequences)"


@query(f"with {_SEQ} select sequence_path, md5(substr(q, 101) || substr(q, 1, 100)) as shifted, md5(reverse(q)) as reversed, md5(repeat(substr(q, 1, 10), 5)) as repeated from s")
def smp12_str11_variants(s, d):
    q = src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"]))
    return q.select("sequence_path", F.md5(seq.rotated(F.col("sequence"), 100)).alias("shifted"), F.md5(F.reverse("sequence")).alias("reversed"), F.md5(F.repeat(F.substring("sequence", 1, 10), F.lit(5))).alias("repeated"))


@query(f"with {_SEQ} select sequence_path, case when q = '' then 'empty' when not regexp_full_match(q, '[ATCGN]+') then 'alphabet' when length(q) < 500 then 'short' when length(q) > 10000 then 'long' end as error from s where q = '' or not regexp_full_match(q, '[ATCGN]+') or length(q) not between 500 and 10000")
def sta21_sequence_errors(s, d):
    return seq.sequence_errors(src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"])), "sequence_path", "sequence", 500, 10_000)


@query(f"with {T} select user_id, round(avg(x), 6) as mean, round(max(x), 6) as max from t where t % 5 <> 0 group by 1")
def vec06_mean_max_pool(s, d):
    return tokens(s, d).where("t % 5 <> 0").groupBy("user_id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("max"))


@query(f"with {V} select i::int as i, j::int as j, round(corr(v[i + 1], v[j + 1]), 6) as corr from v, range(50) a(i), range(50) b(j) where i < j group by all")
def vec10_correlation(s, d):
    cov = vec.covariance(vectors(s, d), "v", 64).where("i < 50 and j < 50")
    var = cov.where("i = j")
    x, y = var.select("i", F.col("cov").alias("_x")), var.select("j", F.col("cov").alias("_y"))
    return cov.where("i < j").join(x, "i").join(y, "j").select("i", "j", F.round(F.try_divide(F.col("cov"), F.sqrt(F.col("_x") * F.col("_y"))), 6).alias("corr"))


@query()
def prj07_whole_series_features(s, d):
    f = vec.series_features(tokens(s, d), ["user_id"], "x")
    return f.select("user_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query()
def prj07_multichannel_series(s, d):
    f = vec.series_features(_token_vectors(s, d), ["label"], "v", channels=64)
    return f.select("label", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query(f"with {V}, {_RP}, x as (select vec_id, label, i, sum(v[j + 1] * w) as x from v, w group by all) select label, i, {_SIX} from x group by all")
def prj08_project_and_pool(s, d):
    import numpy as np

    p = vec.projected(vectors(s, d), "v", np.zeros(64), vec.sparse_axes(64, 8))
    return seq.six_stats(p.select("label", F.posexplode("projected").alias("i", "x")).withColumn("i", F.col("i").cast("long")), ["label", "i"], "x")


@query(_KNN + """, r as (select k.query, q.split, q.phenotype as y, (count(*) filter (where b.phenotype = 1) > count(*) filter (where b.phenotype = 0))::int as p from k join v q on q.vec_id = k.query join v b on b.vec_id = k.neighbour group by all)
select split, count(*) as n, round(avg((y = p)::int::double), 6) as accuracy from r group by 1""")
def agg20_accuracy_by_split(s, d):
    v, n = _knn(s, d)
    voted = vec.votes(n, v, "vec_id", "phenotype").join(v.select(F.col("vec_id").alias("query"), "split"), "query")
    return voted.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 6).alias("accuracy"))


@query("select subset_name, count(*) as n, round(count(*)::double / (select count(*) from used_registry), 6) as share from used_registry group by 1")
def agg22_subsets(s, d):
    return rel.value_shares(table(s, d, "used_registry", ["subset_name"]), "subset_name")


@query(f"with {_SUMMARY} select round(quantile_cont(mcc, 0.25), 6) as p0_25, round(quantile_cont(mcc, 0.5), 6) as p0_5, round(quantile_cont(mcc, 0.75), 6) as p0_75 from s")
def agg23_metric_quartiles(s, d):
    return sta.percentiles(met.classification_summary(predictions(s, d), ["grp"]), [], "mcc", [0.25, 0.5, 0.75])


@query("select event_type, sum(json_extract_string(props, '$.k')::bigint)::bigint as k_sum, count(*) as n from events group by 1")
def jsn01_properties(s, d):
    return table(s, d, "events", ["event_type", "props"]).groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k_sum"), F.count("*").alias("n"))


@query(f"""with {T}, p as (select user_id, count(*) as n, quantile_cont(abs(x), [0.95, 0.99, 0.999]) as p, avg(abs(x)) as m, max(abs(x)) as top from t group by 1)
select user_id, round(m, 4) as mean, round(top, 6) as max, round(case when n < 1000 then p[2] else p[3] end / p[1], 6) as tail_ratio from p""")
def sta11_tail_ratio(s, d):
    return sta.tail_ratio(tokens(s, d), ["user_id"], "x")


@query("select user_id, count(*) filter (where round(abs(value)) in (1, 2, 4, 8, 16, 32, 64)) as n_hits, bool_or(round(abs(value)) in (1, 2, 4, 8, 16, 32, 64)) as hit from events group by 1")
def sta14_constant_hits(s, d):
    e = table(s, d, "events", ["user_id", "value"]).withColumn("x", F.round("value"))
    return sta.constant_hits(e, ["user_id"], "x", [float(2**i) for i in range(7)])


@query(f"""with {T}, c as (select user_id, avg(x) as m, count(*) as n, least(greatest(count(*) // 50, 10), 200) as k from t group by 1),
u as (select user_id, avg(pow(x - m, 4)) / (pow(avg(pow(x - m, 2)), 2) + 1e-12::double) as kurtosis from t join c using (user_id) group by 1),
p as (select user_id, abs(x) as x, k, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by abs(x) desc) as r from t join c using (user_id) where x <> 0),
h as (select user_id, k, n, sum(ln(x)) / k - ln(min(x)) as inv from p where r <= k group by user_id, k, n)
select user_id, c.n, c.k, round(kurtosis, 6) as kurtosis, case when h.n >= greatest(10, c.k + 1) and inv > 0 then round(1 / inv, 6) else 0 end as hill from c join u using (user_id) left join h using (user_id)""")
def sta17_tail_shape(s, d):
    return sta.tail_shape(tokens(s, d), ["user_id"], "x")


@query(f"with {T}, top as (select t from t group by 1 order by max(abs(x)) desc, t limit 5) select t, user_id as layer, round(x, 6) as x, round(x - lag(x) over (partition by t order by user_id), 6) as change from t join top using (t)")
def sta18_trajectory(s, d):
    t = tokens(s, d)
    top = t.groupBy("t").agg(F.max(F.abs("x")).alias("_a")).orderBy(F.desc("_a"), "t").limit(5).select("t")
    return sta.trajectory(t.join(F.broadcast(top), "t").withColumnRenamed("user_id", "layer"), "t", "layer", "x")


@query(f"with {V}, f as (select * from v order by vec_id limit 30) select a.vec_id as a, b.vec_id as b, round(list_distance(a.v, b.v), 6) as distance from f a join f b on a.vec_id < b.vec_id")
def vec11_distances(s, d):
    first = vectors(s, d).orderBy("vec_id").limit(30)
    a, b = first.select(F.col("vec_id").alias("a"), F.col("v").alias("_x")), first.select(F.col("vec_id").alias("b"), F.col("v").alias("_y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(sc.distance(F.col("_x"), F.col("_y")), 6).alias("distance"))


@query(f"""with {_SEQ}, w as (select sequence_path, i, q, ('0x' || substr(md5(sequence_path || ':' || i || ':42'), 1, 12))::bigint % (length(q) - 200 + 1) as start from s, range(3) r(i) where length(q) >= 200)
select sequence_path, i as window_idx, start, md5(substr(q, start + 1, 200)) as bases_md5 from w""")
def smp11_random_windows(s, d):
    q = src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"]))
    return seq.random_windows(q, "sequence_path", "sequence", 3, 200).select("sequence_path", "window_idx", "start", F.md5("window").alias("bases_md5"))


@query(f"""with {M}, g as (select species, genome_id, row_number() over (partition by species order by md5(genome_id || ':42'), genome_id) as r from (select distinct species, genome_id from m where split = 'val_outside' and phenotype = 0)),
o as (select *, row_number() over (order by r > 1, case when r = 1 then species end, md5(genome_id || ':42'), genome_id, species) as n from g) select species, genome_id from o where n <= 40""")
def smp04_each_group_first(s, d):
    g = manifest(s, d).where("split = 'val_outside' and phenotype = 0").select("species", "genome_id").distinct()
    return rel.sample_each_group_first(g, "species", "genome_id", 40)


@query(f"""with {V}, c as (select label, ('0x' || substr(md5(label || ':42'), 1, 6))::bigint as b from (select distinct label from v))
select vec_id, case when b < floor(0.2 * 16777216) then 'validation' when b < floor(0.35 * 16777216) then 'test' else 'train' end as assigned from v join c using (label)""")
def spl02_clustered_split(s, d):
    return rel.hash_split(vectors(s, d), "label", {"validation": 0.2, "test": 0.15}).select("vec_id", "assigned")


@query("""with l as (select genome_id, min(antibiotic_label) as y_true from kover_labels where antibiotic_label in (0, 1) and genome_id is not null group by 1), m as (select distinct genome_id from tiny_manifest where genome_id is not null)
select genome_id, y_true, y_true is not null as known from m left join l using (genome_id)""")
def joi12_aligned_labels(s, d):
    ids = table(s, d, "tiny_manifest", ["genome_id"]).where("genome_id is not null").distinct()
    first = labels(s, d).where("antibiotic_label in (0, 1)").groupBy("genome_id").agg(F.min("antibiotic_label").alias("y_true"))
    return ids.join(first, "genome_id", "left").withColumn("known", F.col("y_true").isNotNull())


@query("select distinct sequence_path from tiny_manifest where sequence_path is not null and sequence_path not in (select sequence_path from sequences where sequence_path is not null)")
def flt15_still_to_do(s, d):
    return table(s, d, "tiny_manifest", ["sequence_path"]).where("sequence_path is not null").join(table(s, d, "sequences", ["sequence_path"]), "sequence_path", "left_anti").distinct()


@query(f"with {T} select user_id, t // 16 as window_idx, list(x order by t) || list_transform(range(16 - count(*)), lambda i: 0.0::double) as series from t group by all")
def win02_padded_windows(s, d):
    return seq.padded_windows(tokens(s, d), "user_id", "x", 16)


@query(f"with {V}, x as (select label, i, v[i + 1] as x from v, range(64) r(i)) select label, i, round(avg(x), 6) as mean, round(max(x), 6) as max, round(stddev_pop(x), 6) as std from x group by all")
def vec03_selected_stats(s, d):
    return seq.selected_stats(_dims(s, d).withColumnRenamed("dim", "i"), ["label", "i"], "x", ["std", "mean", "max"])


@query()
def prj03_standardised_axes(s, d):
    v = vectors(s, d)
    z = vec.standardised(v, "v", 64, v.where("split = 'train'"))
    mean, axes, share = vec.principal_axes(z.where("split = 'train'"), "v", 64, 5)
    return vec.projected(z, "v", mean, axes).select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"), F.lit(round(float(share[:5].sum()), 6)).alias("variance_held"))


_GAUSS = """h as (select i, j, md5('42:' || i || ':' || j) as h from range(8) a(i), range(64) b(j)), e as (select i, j, (('0x' || substr(h, 1, 6))::bigint + 0.5::double) / 16777216.0::double as a, (('0x' || substr(h, 7, 6))::bigint + 0.5::double) / 16777216.0::double as b from h),
w as (select i, j, sqrt(-2 * ln(a) / 8) * cos(2 * pi() * b) as w from e)"""


@query(f"with {V}, {_GAUSS} select vec_id, i, round(sum(v[j + 1] * w), 6) as x from v, w group by all")
def prj04_gaussian_projection(s, d):
    import numpy as np

    p = vec.projected(vectors(s, d), "v", np.zeros(64), vec.gaussian_axes(64, 8))
    return p.select("vec_id", F.posexplode("projected").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"with {V}, {_RP}, k as (select * from v where vec_id % 5 <> 0 qualify row_number() over (partition by label order by md5(vec_id || ':42'), vec_id) <= 32) select label, vec_id, i, round(sum(v[j + 1] * w), 6) as x from k, w group by all")
def prj05_masked_sample(s, d):
    import numpy as np

    valid = vectors(s, d).where("vec_id % 5 <> 0")
    drawn = rel.sample_per_group(valid, ["label"], "vec_id", 32)
    p = vec.projected(drawn, "v", np.zeros(64), vec.sparse_axes(64, 8))
    return p.select("label", "vec_id", F.posexplode("projected").alias("i", "x")).select("label", "vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


# ---------------------------------------------------------------- reports, designs and checks


@query(r"""select distinct coalesce(""" + ", ".join(f"nullif(regexp_extract(n, '{x}', 1), '')" for x in sc.FILE_FORMS) + """) as genome_id from (select regexp_extract(embedding_path, '([^/]+)$', 1) as n from tiny_manifest union all select regexp_extract(sequence_path, '([^/]+)$', 1) from tiny_manifest)""")
def src13_ids_from_data_files(s, d):
    m = table(s, d, "tiny_manifest", ["embedding_path", "sequence_path"])
    return m.select(F.explode(F.array("embedding_path", "sequence_path")).alias("path")).select(sc.id_of_data_file(F.col("path")).alias("genome_id")).distinct()


@query(f"with {P}, g as (select p.*, species from p join m using (row_id)), c as (select species, grp, count(*) as n, sum(y_true) as n_one from g group by all) select species, grp, n, n_one::bigint as n_one from c where n_one > 0 and n_one < n")
def flt10_known_metric(s, d):
    m = manifest(s, d).select("row_id", "species")
    ranked = predictions(s, d).join(m, "row_id")
    auroc = met.ranking_summary(ranked, ["species", "grp"]).dropna(subset=["auroc"])
    return ranked.groupBy("species", "grp").agg(F.count("*").alias("n"), F.sum("y_true").alias("n_one")).join(auroc, ["species", "grp"], "left_semi")


@query(f"with {_SEQ}, c as (select sequence_path, unnest(range((length(q) + 399) // 400)) as i, q from s where length(q) >= 100) select sequence_path, i as window_idx, md5(substr(q, i * 400 + 1, 400)) as bases_md5 from c where length(substr(q, i * 400 + 1, 400)) >= 50")
def flt08_sequence_chunks(s, d):
    q = src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"])).where(F.length("sequence") >= 100)
    return seq.chunks(q, "sequence_path", "sequence", 400, 50).select("sequence_path", "window_idx", F.md5("chunk").alias("bases_md5"))


@query("select count(*) as n_rows, count(*) filter (where genome_id in (select genome_id from genome_metadata where genome_id is not null)) as n_kept, count(*) - count(*) filter (where genome_id in (select genome_id from genome_metadata where genome_id is not null)) as n_lost from kover_labels")
def joi01_rows_lost(s, d):
    return rel.join_losses(table(s, d, "kover_labels", ["genome_id"]), metadata(s, d), "genome_id")


@query(f"with {M} select split, count(*) as n from m group by 1 order by split")
def srt02_sorted_splits(s, d):
    return manifest(s, d).groupBy("split").agg(F.count("*").alias("n")).orderBy("split")


_PLAN_ORDER = ["train", "test_overlapped", "test_outside", "val_overlapped", "val_outside"]


@query(f"with {M} select split, count(*) as n, list_position({_PLAN_ORDER}, split)::bigint as priority from m group by 1 order by priority")
def srt03_plan_order(s, d):
    return rel.in_plan_order(manifest(s, d).groupBy("split").agg(F.count("*").alias("n")), "split", _PLAN_ORDER)


@query(f"with {M} select count(*) as n_rows, count(distinct genome_id) as n_genomes, count(distinct species) as n_species, {_RATES} from m")
def agg07_totals(s, d):
    m = manifest(s, d)
    return rel.rates_by(m, []).withColumns({"n_rows": m.agg(F.count("*")).scalar(), "n_genomes": m.agg(F.count_distinct("genome_id")).scalar(), "n_species": m.agg(F.count_distinct("species")).scalar()})


@query(f"""with {M}, g as (select distinct source_dataset from m), x as (select source_dataset, unnest({list(SPLIT_GROUP)}) as split from g), c as (select source_dataset, split, count(*) as n, sum(phenotype) as r from m group by all)
select x.source_dataset, x.split, coalesce(n, 0) as n, coalesce(r, 0)::bigint as n_resistant, coalesce(round(100.0::double * r / n, 2), 0) as resistant_pct from x left join c on c.split = x.split and c.source_dataset is not distinct from x.source_dataset""")
def agg10_filled_rates(s, d):
    m = manifest(s, d)
    every = m.select("source_dataset").distinct().withColumn("split", F.explode(F.array(*[F.lit(x) for x in SPLIT_GROUP])))
    filled = every.withColumn("_r", F.lit(0).cast("long")).withColumn("_n", F.lit(0).cast("long")).unionByName(m.select("source_dataset", "split", F.col("phenotype").cast("long").alias("_r"), F.lit(1).cast("long").alias("_n")))
    c = filled.groupBy("source_dataset", "split").agg(F.sum("_n").alias("n"), F.sum("_r").alias("n_resistant"))
    return c.withColumn("resistant_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("n_resistant"), F.col("n")), 2), F.lit(0.0)))


@query(f"""with {M}, c as (select split, species, count(*) as n from m group by all), r as (select *, row_number() over (partition by split order by n desc, species) as k, count(*) over (partition by split) as kinds from c),
j as (select split, string_agg(species || ' (' || n || ')', '; ' order by k) filter (where k <= 5) as names, greatest(max(kinds) - 5, 0) as n_more from r group by 1),
a as (select split, count(distinct genome_id) as n_genomes, count(distinct species) as n_species, count(*) filter (where phenotype = 1) as n_resistant, count(*) filter (where phenotype = 0) as n_susceptible from m group by 1)
select a.*, names, n_more, round(100.0::double * n_resistant / (n_resistant + n_susceptible), 1)::decimal(5,1)::varchar || '%' as rate from a join j using (split)""")
def agg16_species_report(s, d):
    return rel.species_report(manifest(s, d), ["split"])


@query(_KNN + ", c as (select neighbour, count(*) as n from k group by 1) select neighbour, n, round(n::double / (select count(*) from k), 6) as share from c order by n desc, neighbour limit 30")
def agg18_most_used(s, d):
    return rel.value_shares(_knn(s, d)[1].select("neighbour"), "neighbour").orderBy(F.desc("n"), "neighbour").limit(30)


@query(_KNN + """, c as (select q.label, b.label as neighbour_label, count(*) as n from k join v q on q.vec_id = k.query join v b on b.vec_id = k.neighbour group by all)
select *, row_number() over (partition by label order by n desc, neighbour_label) as rank from c qualify rank <= 10""")
def agg19_top_neighbour_labels(s, d):
    return rel.top_per_group(agg19_neighbour_labels(s, d), ["label"], [F.desc("n"), F.col("neighbour_label")], 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_SUMMARY}, l as (unpivot (select grp, accuracy, f1, mcc, precision, recall from s) on accuracy, f1, mcc, precision, recall into name metric value value) select metric, round(quantile_cont(value, 0.25), 6) as p0_25, round(quantile_cont(value, 0.5), 6) as p0_5, round(quantile_cont(value, 0.75), 6) as p0_75 from l group by 1")
def agg23_quartiles_by_metric(s, d):
    long = met.long_results(met.classification_summary(predictions(s, d), ["grp"]), ["grp"], ["accuracy", "f1", "mcc", "precision", "recall"])
    return sta.percentiles(long, ["metric"], "value", [0.25, 0.5, 0.75])


@query("""with e as (select unnest(range(64)) as i, unnest(embedding::double[]) as x from embeddings),
p as (select i, avg(x) as m, stddev_pop(x) as s from e group by 1) select round((select min(m) from p), 6) as mean_low, round((select max(m) from p), 6) as mean_high, round((select min(s) from p), 6) as std_low, round((select max(s) from p), 6) as std_high,
round(min(x), 6) as min, round(max(x), 6) as max, round(count(*) filter (where x = 0)::double / count(*), 6) as sparsity, round(quantile_cont(x, 0.5), 6) as median from e""")
def agg25_matrix_summary(s, d):
    return sta.matrix_summary(_dims(s, d), "dim", "x")


@query(f"with {M}, y as (select split, (2 * sum(phenotype) >= count(*))::int as majority from m group by 1) select row_id, majority, phenotype = majority as correct from m join y using (split)")
def agg26_majority_baseline(s, d):
    m = manifest(s, d).select("row_id", "split", "phenotype")
    return m.join(F.broadcast(agg26_majority(s, d)), "split").select("row_id", "majority", (F.col("phenotype") == F.col("majority")).alias("correct"))  # a row for each known split


@query(f"with {_SUMMARY} select grp, to_json({{'tp': tp, 'tn': tn, 'fp': fp, 'fn': fn}})::varchar as counts from s")
def snk06_counts_as_json(s, d):
    return met.classification_summary(predictions(s, d), ["grp"]).select("grp", F.to_json(F.struct("tp", "tn", "fp", "fn")).alias("counts"))


@query(f"""with {M}, a as (select distinct split, species, genome_id from m), t as (select distinct species from a where split = 'train'), q as (select greatest(100 // greatest(least(count(*), 20), 1), 1) as q from t),
f as (select *, md5(genome_id || ':42') as h from a where genome_id not in (select genome_id from used_registry where genome_id is not null)),
tr as (select * from f where split = 'train' qualify row_number() over (partition by species order by h, genome_id) <= (select q from q)),
o as (select * from f where split in ('val_overlapped', 'test_overlapped') and species in (select species from tr) qualify row_number() over (partition by split, species order by h, genome_id) <= 2),
o2 as (select * from o qualify row_number() over (partition by split order by h, genome_id, species) <= 75),
x as (select * from f where split in ('val_outside', 'test_outside') and species not in (select species from t) qualify row_number() over (partition by split order by h, genome_id, species) <= 75)
select split, species, genome_id from tr union all select split, species, genome_id from o2 union all select split, species, genome_id from x""")
def smp05_natural_extraction(s, d):
    return rel.natural_extraction(manifest(s, d), table(s, d, "used_registry", ["genome_id"]))


@query(f"""with {_SEQ}, l as (select sequence_path, list_transform(list_transform(range(length(q)), lambda i: (i * 2654435761 + 9) % 4294967296), lambda h, i: lpad(((xor(h, h >> 15) * 1540483477) % 4294967296)::varchar, 10, '0') || q[i]) as l, q from s)
select sequence_path, md5(array_to_string(list_transform(list_sort(l), lambda x: x[11]), '')) as permuted, md5(repeat('A', length(q))) as all_a, md5(repeat('C', length(q))) as all_c, md5(left(repeat(left(q, 100), 40), length(q))) as repeated_100 from l""")
def smp12_permuted_and_repeated(s, d):
    q = src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"]))
    t, n = F.col("sequence"), F.length("sequence")
    same = lambda letter: F.md5(F.repeat(F.lit(letter), n))
    return q.select("sequence_path", F.md5(seq.permuted(t)).alias("permuted"), same("A").alias("all_a"), same("C").alias("all_c"), F.md5(F.left(F.repeat(F.left(t, F.lit(100)), F.lit(40)), n)).alias("repeated_100"))


_DESIGN = """select '{0}' as level, cluster, n, case when n < 2 or before is null then 'train' when before < {1}::decimal(12,9) * total then 'validation' when before < {2}::decimal(12,9) * total then 'test' else 'train' end as assigned from (
select z.*, sum(n) over () as total, case when n >= 2 then coalesce(sum(case when n >= 2 then n end) over (order by place range between unbounded preceding and 1 preceding), 0) end as before from (select cluster, count(*) as n, ('0x' || substr(md5(cluster || ':0'), 1, 12))::bigint as place from (select {3} as cluster from m) where cluster is not null group by 1) z)"""


@query(f"with {M} " + " union all ".join(_DESIGN.format(*x) for x in (("genus", 0.2, 0.35, "regexp_extract(species, '^([^_ ]+)', 1)"), ("species", 0.2, 0.35, "species"), ("taxa", 0.17, 0.3, "case when contains(genome_id, '.') then split_part(genome_id, '.', 1) else left(genome_id, 10) end"), ("genome_id", 0.1, 0.2, "genome_id"))))
def spl04_named_designs(s, d):
    m = manifest(s, d).select("species", "genome_id")
    every = [rel.designed_split(m, level).select(F.lit(level).alias("level"), "cluster", "n", "assigned") for level in ("genus", "species", "taxa", "genome_id")]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@query(f"with {T}, n as (select user_id, max(t) + 1 as n from t group by 1), b as (select user_id % 2 as class, user_id, case when n <= 1 then 0 else floor(t / (n - 1)::double * (1 - 1e-9::double) * 20) end::int as bin, avg(x) as a from t join n using (user_id) group by all) select class, bin, round(avg(a), 6) as mean, count(*) as n_sequences from b group by all")
def win04_position_bins_by_class(s, d):
    return seq.position_bins(tokens(s, d).withColumn("class", F.col("user_id") % 2), "user_id", "x", 20, ["class"])


@query(f"with {_SEQ}, x as (select sequence_path, q, replace(q, 'T', 'U') as u from s) " + " union all ".join(f"select sequence_path, '{k}' as kind, case when {c} = '' then 'empty' when not regexp_full_match({c}, '[{a}]+') then 'alphabet' end as error from x where {c} = '' or not regexp_full_match({c}, '[{a}]+')" for k, c, a in (("rna", "u", seq.ALPHABETS["rna"]), ("protein", "q", seq.ALPHABETS["protein"]))))
def sta21_other_alphabets(s, d):
    q = src.fasta_sequences(table(s, d, "sequences", ["sequence_path", "fasta"])).withColumn("_rna", F.translate("sequence", "T", "U"))
    rna, protein = (seq.sequence_errors(q, "sequence_path", c, 1, (1 << 31) - 1, seq.ALPHABETS[k]).withColumn("kind", F.lit(k)) for k, c in (("rna", "_rna"), ("protein", "sequence")))
    return rna.unionByName(protein)


@query(f"with {V}, x as (select label, i, v[i + 1] as x from v, range(64) r(i)) select label, i, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.75), 6) as q75 from x group by all")
def vec03_ranked_stats(s, d):
    return seq.selected_stats(_dims(s, d).withColumnRenamed("dim", "i"), ["label", "i"], "x", ["q75", "median", "q25"])
