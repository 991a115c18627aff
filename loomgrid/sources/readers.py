"""Readers for similarity edges, alignment hits, sequences and semi-structured text. Schemas are explicit; bad cells become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# The column layouts of the formats.
EDGES = "query string, reference string, ani double, coverage int, fragments int"
BLAST10 = "qseqid string, sseqid string, pident double, length int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
BLAST12 = "gene string, subject string, pid double, aln_length int, mismatch_count int, gap_open_count int, query_start int, query_end int, subject_start int, subject_end int, e_val double, bit_score double"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def similarity_edges(spark: SparkSession, path: str, any_extension: bool = False) -> DataFrame:
    """Headerless tab-separated edges; names lose their folder and extension. Files with three columns have null in the others."""
    df = spark.read.schema(EDGES).csv(path, sep="\t", mode="PERMISSIVE")
    return df.withColumns({c: tx.file_stem(F.col(c), any_extension) for c in ("query", "reference")})


def blast(spark: SparkSession, path: str, columns: int = 10) -> DataFrame:
    """Alignment hits with ``file`` and ``row``, a number in file order that decides ties."""
    df = spark.read.schema(BLAST10 if columns == 10 else BLAST12).csv(path, sep="\t", mode="PERMISSIVE", comment="#")
    return df.select("*", file_name().alias("file"), F.monotonically_increasing_id().alias("row"))


def sheets(spark: SparkSession, path: str, fmt: str = "csv", exclude: tuple[str, ...] = (), **options) -> DataFrame:
    """A folder of tables as the sheets of a workbook: all files by one reader, ``sheet`` from the file or folder name, without the excluded ones."""
    reader = spark.read.options(**({"header": True} | options if fmt == "csv" else options))
    df = reader.format(fmt).load(path)
    return df.withColumn("sheet", F.regexp_replace(file_name(), r"\.[^.]*$", "")).where(~F.col("sheet").isin(*exclude) if exclude else F.lit(True))


def side_by_side(df: DataFrame, left: list[str], right: list[str], names: list[str]) -> DataFrame:
    """Two blocks of columns addressed by position to one long table with ``section`` present or absent; empty rows go."""
    one = lambda columns, section: df.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.lit(section).alias("section"))
    return one(left, "present").unionByName(one(right, "absent")).where(F.coalesce(F.trim(F.col(names[0]).cast("string")), F.lit("")) != "")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, id, sequence, length); records are cut at lines that begin with ``>``."""
    raw = spark.read.text(path, lineSep="\n>").select(file_name().alias("file"), F.regexp_replace("value", r"^>|\r", "").alias("value")).where("trim(value) <> ''")
    header = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr(r"substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return raw.select("file", header.alias("header"), F.regexp_extract(header, r"^(\S+)", 1).alias("id"), body.alias("sequence"), F.length(body).alias("length"))


def region_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Query records renamed to strain__regionN__start-end; an error where a header has no coordinates. Regions count in order of start."""
    from pyspark.sql import Window

    df = fasta(spark, path)
    strain = F.regexp_replace("file", r"\.[^.]*$", "")
    at = lambda k: F.regexp_extract("header", r"(\d+)-(\d+)\s*$", k).try_cast("long")
    df = df.withColumns({"strain": strain, "start": F.coalesce(at(1), F.raise_error(F.concat(F.lit("no coordinates: "), F.col("header"))).cast("long")), "end": at(2)})
    region = F.row_number().over(Window.partitionBy("strain").orderBy("start", "end"))
    return df.withColumn("region", region).withColumn("id", F.format_string("%s__region%d__%d-%d", "strain", "region", "start", "end"))


def target_fasta(spark: SparkSession, path: str, prefix: str = "vOTU_") -> DataFrame:
    """Reference records with ``unit``, the file stem with its prefix."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return fasta(spark, path).withColumn("unit", F.when(F.lower(stem).startswith(prefix.rstrip("_").lower()), stem).otherwise(F.concat(F.lit(prefix), stem)))


def region_summary(spark: SparkSession, path: str) -> DataFrame:
    """Region lines of summary texts: digit-led, ``completeness(score)``, coordinates of four digits or more; other lines are skipped."""
    t = F.col("t")
    raw = spark.read.text(path).select(file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("t"), F.col("value"))
    state = F.try_element_at(t, F.lit(3))
    span = F.regexp_extract("value", r"(\d{4,})-(\d{4,})", 0)
    df = raw.select(
        F.regexp_replace("file", r"\.[^.]*$", "").alias("strain"),
        F.try_element_at(t, F.lit(1)).try_cast("int").alias("region"),
        tx.try_number(F.regexp_extract(F.try_element_at(t, F.lit(2)), r"([0-9.]+)", 1)).alias("length_kb"),
        F.regexp_extract(state, r"^([a-z]+)", 1).alias("completeness"),
        F.regexp_extract(state, r"\((\d+)\)", 1).try_cast("int").alias("score"),
        F.substring_index(span, "-", 1).try_cast("long").alias("start"),
        F.substring_index(span, "-", -1).try_cast("long").alias("end"),
        F.regexp_extract("value", r"(PHAGE_\S+?)(?:\(|,|\s|$)", 1).alias("top_hit"),
    )
    return df.where("region IS NOT NULL AND completeness <> '' AND start IS NOT NULL")


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def factor_hits(spark: SparkSession, path: str) -> DataFrame:
    """(strain, family): first token of each line that is no comment, once per file."""
    raw = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    return raw.select(F.substring_index(file_name(), ".", 1).alias("strain"), F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("family")).distinct()


def result_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents; broken ones are left out, and named by ``broken_documents``."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def broken_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file) of the documents that can't be read, as a warning to show."""
    raw = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("d"))
    return raw.where("d IS NULL OR d._broken IS NOT NULL").select("file")


def sbml_reactions(spark: SparkSession, path: str, rule_attribute: str = "_gene_rule") -> DataFrame:
    """Reactions of an SBML file by the xml source; attributes have a leading underscore."""
    df = spark.read.format("xml").option("rowTag", "reaction").load(path)
    rule = F.col(rule_attribute) if rule_attribute in df.columns else F.lit(None).cast("string")
    return df.select(F.col("_id").alias("reaction"), rule.alias("rule"))


def model_reactions(spark: SparkSession, path: str) -> DataFrame:
    """(strain, reaction) of a folder of model JSON files."""
    df = spark.read.option("multiLine", True).schema("reactions array<struct<id string, gene_reaction_rule string>>").json(path)
    return df.select(F.regexp_replace(file_name(), r"\.[^.]*$", "").alias("strain"), F.explode("reactions").alias("r")).select("strain", F.col("r.id").alias("reaction"), F.col("r.gene_reaction_rule").alias("rule"))


def delimited(spark: SparkSession, path: str, required: list[str], sep: str = ";") -> DataFrame:
    """CSV with required columns: trimmed text, rows without one of them left out."""
    df = spark.read.csv(path, sep=sep, header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.dropna(subset=required).withColumns({c: F.trim(F.col(c).cast("string")) for c in required})


def one_file(spark: SparkSession, pattern: str) -> str:
    """The only path that a pattern matches; an error else."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = [str(f.getPath().toString()) for f in (found or [])]
    if len(names) != 1:
        raise ValueError(f"{pattern} matches {len(names)} files, not one")
    return names[0]


def accumulation_table(spark: SparkSession, pattern: str) -> DataFrame:
    """A table of permutations by number of genomes to rows (permutation, n_genomes, value)."""
    df = spark.read.csv(one_file(spark, pattern), sep="\t", inferSchema=True)
    df = df.withColumn("permutation", F.monotonically_increasing_id())
    names = [c for c in df.columns if c != "permutation"]
    long = df.select("permutation", *(F.col(c).cast("double") for c in names)).unpivot(["permutation"], names, "column", "value")
    return long.select("permutation", (F.regexp_extract("column", r"(\d+)", 1).cast("int") + 1).alias("n_genomes"), "value")


def file_index(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("_edited", "_edit2", "_edit")) -> DataFrame:
    """(stem, path) of the files below a folder; stems lose the given suffixes, a file without one comes first."""
    from pyspark.sql import Window

    df = spark.read.format("binaryFile").load(path).select("path")
    name = tx.file_stem(F.col("path"), any_extension=True)
    stem = F.regexp_replace(name, "(" + "|".join(suffixes) + ")$", "")
    w = Window.partitionBy("stem").orderBy((F.col("stem") != F.col("name")).cast("int"), "path")
    return df.withColumn("name", name).withColumn("stem", stem).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("stem", "path")


def by_alias(tags: DataFrame, features: DataFrame) -> DataFrame:
    """Locus tags to coding sequences (strain, locus_tag, product, start, ...): the first one of each genome, in order of start, that has the tag in its product (``[locus_tag=...]``) or as its own.

    ``BSU_x`` is found in a product as ``x`` and ``BSUx`` too, and as its own
    tag ``CUSTOM_x``; own tags also match without underscores.
    """
    from pyspark.sql import Window

    form = lambda kind, *values: [F.struct(F.lit(kind).alias("kind"), v.alias("form")) for v in values]
    t, rest = F.col("tag"), F.when(F.col("tag").startswith("BSU_"), F.regexp_replace("tag", "BSU_", ""))
    asked = [*form("product", t, rest, F.concat(F.lit("BSU"), rest)), *form("own", t, F.concat(F.lit("CUSTOM_"), rest)), *form("plain", F.replace(t, F.lit("_"), F.lit("")))]
    wanted = tags.select("tag", F.explode(F.array(*asked)).alias("f")).select("tag", "f.*").where("form IS NOT NULL").distinct()
    own = F.coalesce(F.col("locus_tag"), F.lit(""))
    offered = [*form("product", F.regexp_extract(F.coalesce("product", F.lit("")), r"\[locus_tag=([^\]]*)\]", 1)), *form("own", own), *form("plain", F.replace(own, F.lit("_"), F.lit("")))]
    known = features.withColumn("__f", F.explode(F.array(*offered))).select(*features.columns, "__f.kind", "__f.form").where("form <> ''")
    w = Window.partitionBy("tag", "strain").orderBy("start", "end", "locus_tag")
    return wanted.join(known, ["kind", "form"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "kind", "form")
