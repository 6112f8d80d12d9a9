"""From raw documents to a tree of provisions: decoding, paragraphs, and the parser as windows over lines."""

from __future__ import annotations

import codecs
import encodings
import pkgutil
import re
from collections.abc import Iterator
from encodings.aliases import aliases
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.functions.scalars import article_label, canonical_article, collapse, effects_spacing

# The markers of legal drafting, as patterns on one paragraph.
ARTICLE = r"(?iu)^Art\.\s*((?:\d{1,3}(?:\.\d{3})+|\d+)(?:[A-NP-Za-np-z]|-(?:\d+|[A-Za-z]))?(?:\s*(?:º|°|o))?(?:-[A-Za-z0-9]+)?)\s*[.\-–—]?\s*(.*)$"
PARAGRAPH = r"(?iu)^(§\s*(\d+)\s*(?:º|°|o)?|Parágrafo único)\s*[.\-–—]?\s*(.*)$"
ITEM = r"(?iu)^([IVXLCDM]{1,8})\s*[-–—]\s*(.+)$"
SUBITEM = r"(?iu)^([a-z])\)\s*(.+)$"
NOTE = r"(?iu)\s*\((?=(?:Redação dada|Incluído|Revogado|Vigência|Vide|Acrescentado)[^)]{0,260}(?:Lei|Medida Provisória|Emenda Constitucional))[^)]*\)\s*(?:Vigência)?"
HEADINGS = ("ato das disposições constitucionais transitórias", "disposições constitucionais transitórias")
STRUCK = ("⟦REDAÇÃO MARCADA COMO REVOGADA NA FONTE:", "⟧")
#: Pages that a Python worker holds parsed at a time.
PAGES = 64
VARIANT_NOTE = "Passagem repetida no mesmo documento oficial; escopo precisa de revisão. "

_META = re.compile(rb"<meta[^>]+charset\s*=\s*['\"]?([a-z0-9._-]+)", re.I)


@lru_cache(maxsize=1)
def charset_names() -> dict[str, str]:
    """Every label that names a codec, spelt with underscores, and the codec's own name."""
    out = {}
    for label in {*aliases, *(m.name for m in pkgutil.iter_modules(encodings.__path__))}:
        try:
            out[label] = codecs.lookup(label).name
        except (ImportError, LookupError):  # a module that is no codec here
            continue
    return out


def declared_charset(body: Column) -> Column:
    """The charset of a byte-order mark or of a ``<meta>`` in the first 4,096 bytes by its codec's name; ISO-8859-1 for none or an unknown label."""
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    start = F.hex(F.substring(body, 1, 3))
    label = F.regexp_replace(F.lower(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*['\"]?([a-z0-9._-]+)", 1)), "[^a-z0-9.]+", "_")
    names = F.create_map(*(F.lit(x) for pair in sorted(charset_names().items()) for x in pair))
    return (
        F.when(start.startswith("FFFE"), "utf-16le").when(start.startswith("FEFF"), "utf-16be").when(start == "EFBBBF", "utf-8")
        .otherwise(F.coalesce(F.try_element_at(names, F.regexp_replace(label, r"\.", "_")), F.lit("iso-8859-1")))
    )


def is_pdf(body: Column) -> Column:
    return F.hex(F.substring(body, 1, 5)) == "255044462D"


def decode_body(body: bytes) -> str:
    if body.startswith((b"\xff\xfe", b"\xfe\xff")):
        return body.decode("utf-16", "replace")
    if body.startswith(b"\xef\xbb\xbf"):
        return body.decode("utf-8-sig", "replace")
    if m := _META.search(body[:4096]):
        try:
            return body.decode(codecs.lookup(m[1].decode("ascii")).name, "replace")
        except (LookupError, UnicodeError):  # no codec, or none of texts
            pass
    return body.decode("windows-1252", "replace")


class _Paragraphs(HTMLParser):
    """Text of ``<p>`` and ``<li>``; struck passages are set between marks; scripts and styles are dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.struck = 0, []
        self.open: list[tuple[str, list[str]]] = []
        self.done: list[list[str]] = []
        self.all: list[str] = []
        self.marks = self.pdfs = 0

    def _put(self, text: str) -> None:
        self.all.append(text)
        for _, parts in self.open:
            parts.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        if tag in ("p", "li"):
            if tag == "p":
                self._close("p")
            self.open.append((tag, parts := []))
            self.done.append(parts)
        if tag == "a" and re.search(r"\.pdf(?:$|[?#])", named.get("href") or "", re.I):
            self.pdfs += 1
        if tag in ("s", "strike", "del") or "line-through" in (named.get("style") or "").lower():
            self.marks += 1
            self.struck.append(tag)
            self._put(STRUCK[0])

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        if tag in self.struck:
            self.struck.reverse()
            self.struck.remove(tag)
            self.struck.reverse()
            self._put(STRUCK[1])
        if tag in ("p", "li"):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self._put(data.strip())


def paragraphs_of(html: str) -> tuple[list[str], int, int]:
    """Lines of one page, struck passages, PDF links. Without ``<p>`` or ``<li>`` every text node's line counts."""
    parser = _Paragraphs()
    parser.feed(html)
    parser.close()
    lines = [" ".join(" ".join(parts).split()) for parts in parser.done]
    lines = [x for x in lines if x]
    if not lines:
        lines = [" ".join(x.split()) for part in parser.all for x in part.splitlines() if x.strip()]
    return lines, parser.marks, parser.pdfs


def paragraphs(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """``doc``, ``lines`` (array), ``struck``, ``pdfs`` of pages given as text or bytes; null pages have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch of Spark's may hold thousands of pages; a few at a time become Python's
        for part in (b.slice(i, PAGES) for b in batches for i in range(0, b.num_rows, PAGES)):
            got = [paragraphs_of(decode_body(b) if isinstance(b, bytes) else (b or "")) for b in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array([g[0] for g in got], pa.list_(pa.string())), *(pa.array([g[i] for g in got], pa.int32()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, [doc, "lines", "struck", "pdfs"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, body).mapInArrow(run, f"{doc} {kind}, lines array<string>, struck int, pdfs int")


def text_lines(text: Column, least: int = 0) -> Column:
    """Non-blank collapsed lines; null when all together have fewer than ``least`` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: x != "")
    return F.when(F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)) >= least, lines)


def without_notes(line: Column) -> Column:
    # most lines have no bracket, which is found faster than the pattern fails
    bare = F.when(F.contains(line, F.lit("(")), F.regexp_replace(line, NOTE, "")).otherwise(line)
    return F.trim(F.regexp_replace(bare, r"(?iu)\s+Vigência\s*$", ""))


def notes(line: Column) -> Column:
    found = F.array_join(F.transform(F.regexp_extract_all(line, F.lit(NOTE), F.lit(0)), lambda x: F.trim(x)), " ")
    return F.when(F.contains(line, F.lit("(")), found).when(line.isNotNull(), "")


def is_heading(line: Column) -> Column:
    """One of ``HEADINGS``, but for case, white space and dots; only lines with their last word are taken apart."""
    flat = F.lower(F.regexp_replace(collapse(line), r"^[ .:]+|[ .:]+$", ""))
    return F.contains(F.lower(line), F.lit(HEADINGS[1].split()[-1])) & flat.isin(*HEADINGS)


def kind_of(text: Column) -> Column:
    """article, paragraph, item, subitem or continuation; the first that fits."""
    return F.when(text.rlike(ARTICLE), "article").when(text.rlike(PARAGRAPH), "paragraph").when(text.rlike(ITEM), "item").when(text.rlike(SUBITEM), "subitem").otherwise("continuation")


def after_last_heading(rows: DataFrame, doc: str, pos: str, heading: Column) -> DataFrame:
    """``component``: ``adct`` behind a document's last heading, ``body`` before, null on it."""
    last = F.max(F.when(heading, F.col(pos))).over(Window.partitionBy(doc))
    return rows.withColumn("component", F.when(F.col(pos) == last, None).when(F.col(pos) > last, "adct").otherwise("body"))


def carried(rows: DataFrame, doc: str) -> DataFrame:
    """Node ids and parents by carried context. Input: ``pos``, ``text``, ``note``, ``kind``, ``component``."""
    upto = lambda *keys: Window.partitionBy(doc, *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    get = lambda p, i: F.regexp_extract("text", p, i)
    out = rows.where("component is not null")
    prefix = F.when(F.col("component") == "adct", "adct:art:").otherwise("art:")
    out = out.withColumn("art", F.when(F.col("kind") == "article", F.concat(prefix, canonical_article(get(ARTICLE, 1)))))
    out = out.withColumn("a", F.count("art").over(upto("component"))).withColumn("article", F.last("art", ignorenulls=True).over(upto("component"))).where("article is not null")
    unico, number = F.lower(get(PARAGRAPH, 1)).startswith("parágrafo"), F.regexp_replace(get(PARAGRAPH, 2), r"^0+(?=\d)", "")
    par = F.when(F.col("kind") == "paragraph", F.concat("article", F.lit(".par:"), F.when(unico, "unico").otherwise(number)))
    out = out.withColumn("par", par).withColumn("p", F.count("par").over(upto("component", "a")))
    out = out.withColumn("parent", F.coalesce(F.last("par", ignorenulls=True).over(upto("component", "a")), "article"))
    out = out.withColumn("inc", F.when(F.col("kind") == "item", F.concat("parent", F.lit(".inciso:"), F.upper(get(ITEM, 1)))))
    item = F.last("inc", ignorenulls=True).over(upto("component", "a", "p"))
    out = out.withColumn("item", item)
    holder = F.coalesce("item", "parent")
    by = lambda *v: F.when(F.col("kind") == "article", v[0]).when(F.col("kind") == "paragraph", v[1]).when(F.col("kind") == "item", v[2]).when(F.col("kind") == "subitem", v[3])
    return out.select(
        doc, "pos", "kind", "note",
        F.coalesce(by(F.col("art"), F.col("par"), F.col("inc"), F.concat(holder, F.lit(".alinea:"), F.lower(get(SUBITEM, 1)))), "parent").alias("node_id"),
        by(F.lit(None), F.col("article"), F.col("parent"), holder).alias("parent_id"),
        F.coalesce(by(article_label(get(ARTICLE, 1)), F.when(unico, "Parágrafo único").otherwise(F.concat(F.lit("§ "), number, F.lit("º"))), F.upper(get(ITEM, 1)), F.lower(get(SUBITEM, 1))), F.lit("")).alias("label"),
        collapse(F.coalesce(by(get(ARTICLE, 2), get(PARAGRAPH, 3), get(ITEM, 2), get(SUBITEM, 2)), "text")).alias("text"),
    )


def legal_nodes(docs: DataFrame, doc: str, lines: str = "lines") -> DataFrame:
    """Provisions of every document: ``doc, node_id, parent_node_id, node_type, label, text, source_note, order_index``.

    A repeated id with equal text merges its notes, with different text it becomes a variant; continuation
    lines append to the current article or paragraph unless it contains them. Both depend on what came before,
    so each node's events are folded in order. Markers without text emit nothing but still carry context.
    """
    rows = docs.select(doc, F.posexplode(lines).alias("pos", "raw"))
    rows = rows.select(doc, "pos", without_notes(F.col("raw")).alias("text"), notes(F.col("raw")).alias("note"), is_heading(F.col("raw")).alias("heading"))
    rows = after_last_heading(rows, doc, "pos", F.col("heading")).drop("heading")
    rows = rows.withColumn("kind", F.when(F.col("text") == "", "note").otherwise(kind_of(F.col("text"))))
    events = carried(rows, doc)
    real = events.where("kind <> 'note' and (text <> '' or kind = 'article')")
    folded = real.groupBy(doc, "node_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "note", "label", "parent_id"))).alias("ev"))
    state = F.struct(F.lit(False).alias("has"), F.lit("").alias("text"), F.lit("").alias("note"), F.array().cast("array<int>").alias("variants"), F.lit(-1).alias("first"))

    def step(s: Column, e: Column) -> Column:
        more = e["kind"] == "continuation"
        append = more & s["has"] & ~F.contains(s["text"], e["text"])
        define, same = ~more & ~s["has"], ~more & s["has"] & (e["text"] == s["text"])
        return F.struct(
            (s["has"] | define).alias("has"),
            F.when(append, F.trim(F.concat(s["text"], F.lit(" "), e["text"]))).when(define, e["text"]).otherwise(s["text"]).alias("text"),
            F.when(define, e["note"]).when(same, F.array_join(F.filter(F.array(s["note"], e["note"]), lambda x: x != ""), " ")).otherwise(s["note"]).alias("note"),
            F.when(~more & s["has"] & (e["text"] != s["text"]), F.concat(s["variants"], F.array(e["pos"]))).otherwise(s["variants"]).alias("variants"),
            F.when(define, e["pos"]).otherwise(s["first"]).alias("first"),
        )

    folded = folded.withColumn("s", F.aggregate("ev", state, step)).where("s.has")
    kept = folded.select(doc, "node_id", "s", F.explode(F.filter("ev", lambda e: (e["pos"] == F.col("s.first")) | F.array_contains(F.col("s.variants"), e["pos"]))).alias("e"))
    variant = F.col("e.pos") != F.col("s.first")
    order = F.row_number().over(Window.partitionBy(doc).orderBy("e.pos"))
    kept = kept.withColumn("order_index", order)
    nodes = kept.select(
        doc, F.col("e.pos").alias("pos"), "order_index",
        F.when(variant, F.concat("node_id", F.lit(".source-variant:"), F.col("order_index").cast("string"))).otherwise(F.col("node_id")).alias("node_id"),
        F.when(variant & (F.col("e.kind") == "article"), F.col("node_id")).otherwise(F.col("e.parent_id")).alias("parent_node_id"),
        F.when(variant, "variant").otherwise(F.col("e.kind")).alias("node_type"),
        F.when(variant, F.concat("e.label", F.lit(" — redação alternativa na fonte"))).otherwise(F.col("e.label")).alias("label"),
        F.when(variant, F.col("e.text")).otherwise(F.col("s.text")).alias("text"),
        F.when(variant, F.concat(F.lit(VARIANT_NOTE), "e.note")).otherwise(F.col("s.note")).alias("source_note"),
    )
    # a paragraph of notes alone belongs to the node before it, if that is the current article or paragraph
    alone = events.where("kind = 'note' and note <> ''").select(doc, "pos", F.lit(None).cast("int").alias("order_index"), F.lit(None).cast("string").alias("own"), F.col("node_id").alias("wanted"), "note")
    line = nodes.select(doc, "pos", "order_index", F.col("node_id").alias("own"), F.lit(None).cast("string").alias("wanted"), F.lit("").alias("note")).unionByName(alone)
    back = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("last_id", F.last("own", ignorenulls=True).over(back)).withColumn("last_order", F.last("order_index", ignorenulls=True).over(back)).where("wanted = last_id")
    extra = line.groupBy(doc, F.col("last_order").alias("order_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "note"))), lambda x: x["note"]), " ").alias("extra"))
    out = nodes.join(extra, [doc, "order_index"], "left")
    note = F.trim(F.concat_ws(" ", "source_note", "extra"))
    return out.select(doc, "node_id", "parent_node_id", "node_type", "label", "text", note.alias("source_note"), "order_index")


def whole_documents(docs: DataFrame, nodes: DataFrame, doc: str, lines: str = "lines") -> DataFrame:
    """One ``document`` node with the whole text for documents without provisions; blank ones are rejected."""
    rest = docs.join(nodes.select(doc).distinct(), doc, "left_anti").select(doc, F.array_join(lines, "\n").alias("text"))
    return rest.where("trim(text) <> ''").select(doc, F.lit("document").alias("node_id"), "text")


def audit(lines: DataFrame, nodes: DataFrame, doc: str) -> DataFrame:
    """Per document: article markers in the source against parsed articles. It reports gaps and never certifies completeness.

    ``lines``: doc, lines, struck, pdfs; ``nodes``: doc, node_id, node_type, text.
    """
    rows = lines.select(doc, "struck", "pdfs", F.posexplode_outer("lines").alias("pos", "raw"))
    heads = F.sum(is_heading(F.col("raw")).cast("int")).over(Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("after", heads)
    marked = rows.where(F.col("raw").rlike(ARTICLE)).select(
        doc, F.concat(F.when(F.col("after") > 0, "adct:art:").otherwise("art:"), canonical_article(F.regexp_extract("raw", ARTICLE, 1))).alias("node_id"), (F.trim(F.regexp_extract("raw", ARTICLE, 2)) == "").alias("empty"))
    source = marked.groupBy(doc, "node_id").agg(F.count("*").alias("times"), F.bool_or("empty").alias("empty"))
    parsed = nodes.where("node_type = 'article'").select(doc, "node_id", F.lit(True).alias("parsed")).distinct()
    both = source.join(parsed, [doc, "node_id"], "full_outer")
    of = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(c, F.col("node_id")))))
    found = both.groupBy(doc).agg(
        of(F.col("parsed").isNull()).alias("missing"), of(F.col("times").isNull()).alias("unexpected"), of(F.col("times") > 1).alias("repeated"), of(F.col("empty")).alias("empty_articles"),
        F.coalesce(F.sum("times"), F.lit(0)).alias("source_articles"), F.count("parsed").alias("parsed_articles"))
    sizes = lines.select(doc, "struck", "pdfs", F.size("lines").alias("paragraphs"), F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x)).alias("source_characters"))
    chars = nodes.groupBy(doc).agg(F.count("*").alias("node_count"), F.sum(F.length("text")).alias("node_characters"))
    out = sizes.join(found, doc, "left").join(chars, doc, "left")
    gaps = (F.coalesce(F.size("missing"), F.lit(0)) > 0) | (F.coalesce(F.size("empty_articles"), F.lit(0)) > 0)
    return out.withColumn("assessment", F.when(gaps, "gaps_detected").otherwise("review_required")).withColumn("completeness_certified", F.lit(False))


def corpus_audit(laws: DataFrame, versions: DataFrame, snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``audit`` of every law's current version against its archived source, with ``status``: ``audited`` or ``skipped_without_snapshot``.

    ``laws``: law, current_version (null: not examined); ``versions``: version, checksum; ``snapshots``: law, checksum,
    retrieved_at, lines, struck, pdfs (the oldest of equal law and checksum is read); ``nodes``: version and what ``audit`` reads.
    """
    current = laws.where("current_version is not null").select("law", F.col("current_version").alias("version"))
    current = current.join(versions.select("version", "checksum"), "version", "left")
    first = snapshots.groupBy("law", "checksum").agg(F.min(F.struct("retrieved_at", "lines", "struck", "pdfs")).alias("s"))
    found = current.join(first, ["law", "checksum"]).select("law", "version", F.col("checksum").alias("source_checksum"), F.col("s.retrieved_at").alias("audited_at"), "s.lines", "s.struck", "s.pdfs")
    audits = audit(found, nodes.join(found.select("law", "version"), "version"), "law")
    out = current.select("law", "version").join(found.select("law", "source_checksum", "audited_at"), "law", "left").join(audits, "law", "left")
    status = F.when(F.col("source_checksum").isNull(), "skipped_without_snapshot").otherwise("audited")
    return out.withColumn("status", status).withColumn("completeness_certified", F.lit(False))


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row: laws examined, audited and skipped; none is ever certified as complete."""
    skipped = F.count_if(F.col("status") == "skipped_without_snapshot")
    return audited.agg(F.count("*").alias("examined"), (F.count("*") - skipped).alias("audited"), skipped.alias("skipped_without_snapshot"), F.count_if("completeness_certified").alias("completeness_certified"))


def reader_groups(nodes: DataFrame, doc: str) -> DataFrame:
    """Each article with the provisions up to the next one: doc, order_index, article, number, title, text and ``clauses``
    (node_id, kind, label, text) in order. What stands before the first article belongs to none; the array holds one article.
    """
    before = Window.partitionBy(doc).orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.col("node_type") == "article"
    rows = nodes.withColumn("__head", F.last(F.when(heads, F.col("order_index")), ignorenulls=True).over(before)).where("__head is not null")
    label = F.concat("label", F.when(F.col("node_type") == "paragraph", " ").otherwise(" — "))
    clause = F.struct("order_index", "node_id", F.when(F.col("node_type").isin("item", "subitem"), F.col("node_type")).otherwise("").alias("kind"), label.alias("label"), effects_spacing(F.col("text")).alias("text"))
    head = F.struct("node_id", "label", effects_spacing(F.col("text")).alias("text"))
    out = rows.groupBy(doc, F.col("__head").alias("order_index")).agg(F.max(F.when(heads, head)).alias("a"), F.array_sort(F.array_compact(F.collect_list(F.when(~heads, clause)))).alias("c"))
    title = F.when(F.col("a.label").rlike("[º.]$"), F.col("a.label")).otherwise(F.concat("a.label", F.lit(".")))
    return out.select(doc, "order_index", F.col("a.node_id").alias("article"), F.regexp_replace("a.node_id", "^art:", "").alias("number"), title.alias("title"), "a.text", F.transform("c", lambda c: c.dropFields("order_index")).alias("clauses"))


def subset(nodes: DataFrame, node_id: str, prefix: str) -> DataFrame:
    """A provision and all below it."""
    return nodes.where((F.col(node_id) == prefix) | F.col(node_id).startswith(prefix + "."))


def identity_ok(text: Column, year: Column, number: Column, kind: Column) -> Column:
    """At least 80 characters, naming the year, the number's digits and the type's first word (marks ignored)."""
    from normspark.functions.scalars import digits_only, without_marks

    flat = F.lower(without_marks(text))
    word = F.lower(without_marks(F.substring_index(kind, " ", 1)))
    return (F.length(text) >= 80) & F.contains(text, year.cast("string")) & F.contains(digits_only(text), digits_only(number)) & F.contains(flat, word)


def representation_order(version: str, name: str, published: str, value: str) -> list[Column]:
    """Sort order of representations: current, original that is no erratum, no erratum, newest; official ones first."""
    words = F.lower(F.concat_ws(" ", name, version))
    erratum = words.rlike("retificacao|retificação|erratum")
    original = (F.lower(version) == "original") | F.lower(F.coalesce(name, F.lit(""))).rlike("publicacaooriginal|publicação original|original publication")
    current = F.lower(version) == "current"
    return [F.desc(F.coalesce(c.cast("int"), F.lit(0))) for c in (current, original & ~erratum, ~erratum)] + [F.desc(F.coalesce(published, F.lit(""))), F.desc(F.col(value) == "OfficialLegalValue")]


def new_versions(archive: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose (law, checksum, parser version) the archive lacks, once each."""
    return incoming.dropDuplicates(key).join(archive.select(*key).distinct(), key, "left_anti")


def with_current(versions: DataFrame, law: str, newest: list[Column]) -> DataFrame:
    """Exactly one current version a law: the one of the greatest ``newest``, which tells a law's versions apart."""
    top = versions.groupBy(law).agg(F.max(F.struct(*newest)).alias("__top"))
    return versions.join(top, law).withColumn("is_current", F.struct(*newest) == F.col("__top")).drop("__top")
