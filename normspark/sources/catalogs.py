"""Readers of landed catalog pages: each gives one row per norm and a ``reject`` reason that is null for valid rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark import schemas
from normspark.functions.scalars import any_date, collapse, official_number
from normspark.operators.catalog import reject_reasons
from normspark.sources import landed
from normspark.storage import stored

ALESP = landed.Shape("content", "$.number", ("$.totalElements", "$.totalPages"), "$.idNorma")
SAPL = landed.Shape("results", "$.pagination.page", ("$.pagination.total_entries",), "$.id")
SINJ = landed.Shape("aaData", None, ("$.iTotalDisplayRecords",), "$._id")


def _text(x: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def _reason(checks: dict[str, Column], page: str | None = None) -> Column:
    """Reasons against a row, or the column ``page`` with those against its whole page."""
    own = F.nullif(reject_reasons(checks), F.lit(""))
    return (F.coalesce(F.col(page), own) if page else own).alias("reject")


def senate(spark: SparkSession, path: str, law_type: str, expected_year: int | None = None) -> DataFrame:
    """XML lists, one ``documento`` a norm. Identical repeats collapse; the merge's gates find conflicting ones."""
    rows = spark.read.format("xml").option("rowTag", "documento").schema(schemas.SENATE_LIST).load(path)
    year = F.expr("try_cast(trim(anoassinatura) as int)")
    title = _text("normaNome")
    return rows.select(
        _text("_id").alias("remote_id"), F.lit(law_type).alias("law_type"), official_number(title, _text("numero")).alias("number"), year.alias("year"),
        F.try_to_date(_text("dataassinatura"), "dd/MM/yyyy").alias("signed_at"), F.left(title, F.lit(300)).alias("title"), _text("ementa").alias("description"), _text("norma").alias("source_urn"),
        _reason({"id": ~_text("_id").rlike("^[0-9]+$"), "year": year.isNull() | ~year.between(1800, 2200), "title": title == "", "partition": F.lit(False) if expected_year is None else year != expected_year}),
    ).distinct()


def alesp(spark: SparkSession, path: str, numbered: str | None = None, strict: bool = False) -> DataFrame:
    """JSON pages with ``content``; a text link stays only with https, the official host and path. A rejected page is one row with its reasons."""
    rows = landed.records(landed.pages(spark, path, ALESP, numbered, strict), schemas.ALESP_PAGE, "content").select(F.col("page").cast("int").alias("number"), F.col("r").alias("c"), "page_reject")
    title, signed = _text("c.nomeNorma"), any_date(F.col("c.data"))
    url = F.nullif(_text("c.urlIntegraListaPesquisa"), F.lit(""))
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(url, F.lit("HOST")) == "www.al.sp.gov.br") & F.try_parse_url(url, F.lit("PATH")).startswith("/repositorio/legislacao/")
    return rows.select(
        _text("c.idNorma").alias("remote_id"), F.col("number").alias("page"), _text("c.tipo").alias("law_type"), official_number(title, _text("c.nuNorma")).alias("number"), F.year(signed).alias("year"),
        signed.alias("signed_at"), any_date(F.col("c.dataPublicacao")).alias("published_at"), F.left(title, F.lit(300)).alias("title"), _text("c.dsEmenta").alias("description"), F.when(ok, url).alias("text_url"),
        _reason({"id": ~_text("c.idNorma").rlike("^[0-9]+$"), "type": _text("c.tipo") == "", "title": title == "", "date": signed.isNull()}, "page_reject"),
    )


def sapl(spark: SparkSession, path: str, types: DataFrame, scope: str = "", numbered: str | None = None, strict: bool = False) -> DataFrame:
    """JSON pages with ``results``; type ids through the small lookup ``types`` (id, law_type); scope "", M, E or F. A rejected page is one row with its reasons."""
    rows = landed.records(landed.pages(spark, path, SAPL, numbered, strict), schemas.SAPL_PAGE, "results").withColumn("page", F.col("page").cast("int"))
    rows = rows.join(types.select(F.col("id").alias("type_id"), "law_type"), F.col("r.tipo") == F.col("type_id"), "left")
    sphere, year = F.upper(_text("r.esfera_federacao")), F.expr("try_cast(r.ano as int)")
    number = F.coalesce(F.nullif(_text("r.numero"), F.lit("")), F.lit("s/n"))
    title = F.coalesce(F.nullif(_text("r.__str__"), F.lit("")), F.concat("law_type", F.lit(" "), number, F.lit("/"), year.cast("string")))
    return rows.select(
        _text("r.id").alias("remote_id"), "page", "law_type", number.alias("number"), year.alias("year"), any_date(F.col("r.data")).alias("signed_at"), any_date(F.col("r.data_publicacao")).alias("published_at"),
        F.left(title, F.lit(300)).alias("title"), _text("r.ementa").alias("description"), sphere.alias("scope"), F.col("r.texto_integral").alias("text_url"),
        _reason({"id": ~_text("r.id").rlike("^[0-9]{1,24}$"), "type": F.col("law_type").isNull(), "year": year.isNull(), "scope": ~sphere.isin("", "M", "E", "F") | (sphere != scope if scope else F.lit(False)), "number": F.length(number) > 96}, "page_reject"),
    )


def sinj(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON pages with ``aaData``: first parseable publication date, sorted distinct attachment types. A rejected page is one row with its reasons."""
    rows = landed.records(landed.pages(spark, path, SINJ, None, strict), schemas.SINJ_PAGE, "aaData").select("page_reject", "r._id", "r._source.*")
    signed, kind, remote = any_date(F.col("dt_assinatura")), _text("nm_tipo_norma"), F.lower(_text("ch_norma"))
    number = F.when(_text("nr_norma").isin("", "0"), "s/n").otherwise(_text("nr_norma"))
    dates = F.array_compact(F.transform("fontes", lambda f: any_date(f["dt_publicacao"])))
    mimes = F.concat(F.coalesce(F.transform("fontes", lambda f: F.lower(F.trim(f["ar_fonte"]["mimetype"]))), F.array().cast("array<string>")), F.array(F.lower(F.trim("ar_atualizado.mimetype"))))
    return rows.select(
        remote.alias("remote_id"), _text("_id").alias("document_id"), kind.alias("law_type"), number.alias("number"), F.year(signed).alias("year"), signed.alias("signed_at"), F.get(dates, F.lit(0)).alias("published_at"),
        F.left(F.concat(kind, F.lit(" "), number, F.lit(" de "), F.date_format(signed, "dd/MM/yyyy")), F.lit(300)).alias("title"), _text("ds_ementa").alias("description"),
        F.left(F.coalesce(F.nullif(_text("nm_situacao"), F.lit("")), F.lit("Não verificado")), F.lit(48)).alias("status"),
        F.array_sort(F.array_distinct(F.filter(mimes, lambda m: m.isNotNull() & (m != "")))).alias("attachments"),
        _reason({"id": ~remote.rlike("^([0-9a-f]{32}|[0-9]{1,24})$") | ~_text("_id").rlike("^[0-9]+$"), "type": (kind == "") | (F.length(kind) > 48), "number": F.length(number) > 96, "date": signed.isNull()}, "page_reject"),
    )


#: Places with a code but no legislature of their own.
NO_LEGISLATURE = ("5300108", "2605459")


def jurisdictions(spark: SparkSession, states: str, places: str) -> DataFrame:
    """One table of the federation, its states and municipalities with parent ids; the UF may sit on several paths."""
    uf = F.coalesce(F.when(F.length("sigla") == 2, F.col("sigla")), F.col("microrregiao.mesorregiao.UF.sigla"), F.col("`regiao-imediata`.`regiao-intermediaria`.UF.sigla"))
    read = spark.read.option("multiLine", True).schema(schemas.IBGE_PLACE)
    top = spark.range(1).select(F.lit("br").alias("id"), F.lit("federal").alias("kind"), F.lit("Brasil").alias("name"), F.lit(None).cast("string").alias("uf"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("legislature_eligible"))
    state = read.json(states).select(F.concat(F.lit("br-"), F.lower("sigla")).alias("id"), F.lit("state").alias("kind"), F.col("nome").alias("name"), F.col("sigla").alias("uf"), F.lit("br").alias("parent_id"), F.lit(True).alias("legislature_eligible"))
    town = read.json(places).select(F.concat(F.lit("br-"), F.lower(uf), F.lit("-"), "id").alias("id"), F.lit("municipality").alias("kind"), F.col("nome").alias("name"), uf.alias("uf"), F.concat(F.lit("br-"), F.lower(uf)).alias("parent_id"), (~F.col("id").isin(*NO_LEGISLATURE)).alias("legislature_eligible"))
    return top.unionByName(state).unionByName(town)


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, path, size and time of landed documents: all files below a folder, which executors list (a glob is walked by the driver, folder by folder).

    The folders are listed when this is called, by a few tasks for each of a shuffle's; Spark would start up to 10,000, most for one folder each.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    finally:
        spark.conf.set(name, before)
    return files.select("path", F.col("content").alias("raw_body"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("retrieved_at"))


def archive(snapshots: DataFrame, incoming: DataFrame) -> DataFrame:
    """Content-addressed rows to append: (law, checksum) that the archive lacks, with their object key."""
    sha = F.sha2("raw_body", 256)
    rows = incoming.withColumn("checksum", sha).dropDuplicates(["law_slug", "checksum"])
    rows = rows.join(snapshots.select("law_slug", "checksum"), ["law_slug", "checksum"], "left_anti")
    return rows.withColumn("sha_prefix", F.left("checksum", F.lit(2))).withColumn("object_key", F.concat(F.lit("sha256/"), F.left("checksum", F.lit(2)), F.lit("/"), "checksum"))


def with_version_ids(snapshots: DataFrame, incoming: DataFrame) -> DataFrame:
    """The archive's rows, those without a ``version_id`` taking the least one that ``incoming`` (law_slug, checksum, version_id) has for them."""
    known = incoming.where("version_id is not null").groupBy("law_slug", "checksum").agg(F.min("version_id").alias("__id"))
    out = snapshots.join(known, ["law_slug", "checksum"], "left").withColumn("version_id", F.coalesce("version_id", "__id")).drop("__id")
    return out.select(*snapshots.columns)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``rows`` touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_partitioned(rows: DataFrame, path: str, by: str, key: list[str]) -> None:
    """Merge ``rows`` into the table at ``path``: rows of the same ``by`` and ``key`` are replaced, others kept; only touched partitions are written."""
    spark = rows.sparkSession
    rows = stored(rows, "incoming")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.schema(rows.schema).parquet(path)
        touched = rows.select(by).distinct()
        kept = old.join(touched, by, "left_semi").join(rows.select(by, *key), [by, *key], "left_anti").select(*rows.columns)
        rows = stored(kept.unionByName(rows), "merged")  # read before its partitions are overwritten
    write_partitioned(rows, path, by)


#: The curated seed laws.
SEEDS = (
    ("lgpd", "Lei", "13.709", 2018, "Lei Geral de Proteção de Dados Pessoais", ("LGPD", "Lei de proteção de dados")),
    ("codigo-civil", "Lei", "10.406", 2002, "Código Civil", ("CC", "Código Civil brasileiro")),
    ("maria-da-penha", "Lei", "11.340", 2006, "Lei Maria da Penha", ("LMP",)),
)


def seed_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEEDS), "slug string, law_type string, number string, year int, title string, aliases array<string>")


def excerpt(html: Column, most: int = 1600) -> Column:
    return F.left(collapse(F.regexp_replace(html, "<[^>]*>", " ")), F.lit(most))
