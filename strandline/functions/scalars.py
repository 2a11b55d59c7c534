"""Scalar expressions: phenotypes, ids, names, tokens, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phenotype spellings and what they mean.
RESISTANT = ("1", "r", "resistant", "resistance", "non-susceptible", "nonsusceptible")
SUSCEPTIBLE = ("0", "s", "susceptible", "sensitive")

# Label columns by preference.
LABEL_ALIASES = ("label", "antibiotic_label", "resistance_label", "amr_label")


def phenotype_of_text(c: Column) -> Column:
    """1 for resistant spellings, 0 for susceptible ones, else null; case and outer blanks do not count."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*RESISTANT), 1).when(t.isin(*SUSCEPTIBLE), 0)


def numeric_id(c: Column) -> Column:
    """An id of the form digits.digits without leading and trailing zeros (one decimal stays); others unchanged."""
    bare = F.regexp_replace(F.regexp_replace(c, "^0+([0-9])", "$1"), "([.][0-9]+?)0*$", "$1")
    return F.when(c.rlike("^[0-9]+[.][0-9]+$"), bare).otherwise(c)


def comparable_id(c: Column) -> Column:
    """numeric_id, lower case, without outer blanks."""
    return F.lower(F.trim(numeric_id(c)))


def taxon_of(c: Column) -> Column:
    """What stands before the first dot; without a dot the first ten characters."""
    return F.when(F.instr(c, ".") > 0, F.split_part(c, F.lit("."), F.lit(1))).otherwise(F.left(c, F.lit(10)))


def genome_of_path(c: Column) -> Column:
    """Genome id in a file name: digits.digits at the start of the last path component, else the name's stem."""
    name = F.regexp_extract(c, "([^/]+)$", 1)
    found = F.regexp_extract(name, "^([0-9]+[.][0-9]+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(name, "(_raw|_contigs)?[.].*$", ""))


# Forms of the names of data files, of which the first that fits gives the id.
FILE_FORMS = (
    r"^([^_]+)_pca_stats_dim\d+\.(npz|csv)$",
    r"^([^_]+)_mr_win\d+_s\d+\.npz$",
    r"^([^_]+)_pooled_embeddings\.(npz|csv)$",
    r"^([^_]+)_embeddings\.(h5|hdf5)$",
    r"^([^_]+)\.npz$",
    r"^([^_]+)\.csv$",
    r"^([^_]+)\.h5$",
)


def id_of_data_file(c: Column) -> Column:
    """Genome id in the last component of a path, by the first form that fits; null where none does."""
    name = F.regexp_extract(c, "([^/]+)$", 1)
    return F.coalesce(*[F.nullif(F.regexp_extract(name, form, 1), F.lit("")) for form in FILE_FORMS])


def shortened(c: Column, most: int = 50) -> Column:
    """Names longer than `most` end in three dots at that length."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def byte_tokens(c: Column) -> Column:
    """UTF-8 bytes of a text as integers."""
    hexed = F.hex(F.encode(c, "UTF-8"))
    at = F.sequence(F.lit(0), F.octet_length(c) - 1)
    return F.when(F.octet_length(c) > 0, F.transform(at, lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).when(c.isNotNull(), F.array().cast("array<int>"))


def padded(tokens: Column, length: int, pad: int = 0) -> Column:
    """Tokens cut or padded to one length."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(gap, gap))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once and not again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def l2_normalised(v: Column, eps: float = 1e-12) -> Column:
    """The vector over its length, which counts as eps at least."""
    return _let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def layer_normalised(v: Column, eps: float = 1e-5) -> Column:
    """Mean 0 and biased variance 1 over the vector, eps added to the variance."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    centred = lambda x: _let(total(x) / F.size(x), lambda m: F.transform(x, lambda y: y - m))
    scaled = lambda x: _let(F.sqrt(dot(x, x) / F.size(x) + eps), lambda d: F.transform(x, lambda y: y / d))
    return _let(v, lambda x: _let(centred(x), scaled))


def clipped(v: Column, low: float, high: float) -> Column:
    """Elements within [low, high]; NaN becomes 0."""
    return F.transform(v, lambda x: F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(low)), F.lit(high)))


def hash_order(c: Column, seed: int = 42) -> Column:
    """An order that looks random, and is the same in any engine with md5."""
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))
