"""Layered documents: regions of pages, their text layers, and LaTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import differs, layer_text, let, nonempty, strip, tex

LAYERS = ("diplomatic", "normalized", "translation")
FLOWING = ("paragraph", "list_item", "epigraph", "mathematical_expression", "colophon", "table_cell")


def region_type(bbox: dict[str, Column], width: Column, height: Column, spans: Column) -> Column:
    """What a block of a page is, by its place and its fonts; ``spans`` is an array of ``text, size, flags``."""
    # The thresholds, and the order in which they are asked.
    x0, y0, x1, y1 = (bbox[k] for k in ("x0", "y0", "x1", "y1"))
    said = F.filter(spans, lambda s: F.coalesce(s["text"].rlike(r"(?U)\S"), F.lit(False)))
    sizes = lambda said: F.array_sort(F.transform(said, lambda s: s["size"]))
    bold = lambda said: F.exists(said, lambda s: F.coalesce(s["flags"], F.lit(0)).bitwiseAND(16) != 0)
    raw = lambda said: F.array_join(F.transform(said, lambda s: s["text"]), " ")

    def by_fonts(said: Column, sizes: Column) -> Column:
        middle, largest = F.try_element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int")), F.try_element_at(sizes, F.lit(-1))
        return (
            F.when(F.size(said) == 0, "paragraph")
            .when((middle <= 8.5) & (y0 > height * 0.70), "footnote")
            .when(middle <= 7.5, "footnote")
            .when(largest >= 14.0, "heading")
            .when((largest >= 11.5) & bold(said), "subheading")
            .when((x1 - x0 < width * 0.22) & ((x0 < width * 0.07) | (x1 > width * 0.93)), "margin_note")
            .when((middle <= 9.5) & raw(said).rlike(r"(?i)^(Fig\.|Table|Plate|Tableau)\s"), "caption")
            .otherwise("paragraph")
        )

    return F.when((y1 < height * 0.08) | (y0 > height * 0.92), "running_title").otherwise(let(said, lambda said: let(sizes(said), lambda sizes: by_fonts(said, sizes))))


IMAGE = 1  # a block's kind, as layout readers number it


def page_regions(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Regions of a document in reading order: images and blank blocks go, the rest is numbered over all pages.

    ``blocks``: ``doc, page, number, kind, x0, y0, x1, y1, width, height, lines`` (lines of spans of ``text, size, flags``).
    """
    text = diplomatic_text(F.col("lines"))
    b = blocks.where(F.col("kind") != IMAGE).withColumn("text", text).where("text <> ''")
    spans = F.flatten(F.transform("lines", lambda ln: ln["spans"]))
    box = {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}
    seq = F.row_number().over(Window.partitionBy(doc).orderBy("page", "number")) - 1
    key = F.sha2(F.concat_ws("\u0001", F.col(doc).cast("string"), "page", "number"), 256)
    return b.select(doc, "page", seq.alias("seq"), key.alias("region_id"), region_type(box, F.col("width"), F.col("height"), spans).alias("region_type"), "text")


def diplomatic_text(lines: Column) -> Column:
    """The spans of each line joined, blank lines dropped."""
    joined = F.transform(lines, lambda ln: F.array_join(F.transform(ln["spans"], lambda s: s["text"]), ""))
    return F.array_join(F.filter(joined, lambda x: strip(x) != ""), "\n")


def text_layers(regions: DataFrame, language: Column, composed: bool = False) -> DataFrame:
    """Three rows a region: the text as it stands, normalised, and its translation (pending unless English)."""
    from corpusloom.functions.unicode import nfc

    norm = layer_text(F.col("text") if composed else nfc(F.col("text")))
    english = language == "eng"
    layer = lambda kind, text, note: F.struct(F.lit(kind).alias("layer_type"), text.alias("text"), note.alias("translation_note"))
    none = F.lit(None).cast("string")
    rows = F.array(layer("diplomatic", F.col("text"), none), layer("normalized", F.col("__norm"), none), layer("translation", F.when(english, F.col("__norm")).otherwise(""), F.when(~english, "pending")))
    keys = [c for c in regions.columns if c != "text"]
    # a column of its own, or it is made for each layer
    return regions.withColumn("__norm", norm).select(*keys, F.explode(rows).alias("l")).select(*keys, "l.*")


def pivoted(layers: DataFrame, key: str = "region_id") -> DataFrame:
    """One row a region with its layers as columns; the layer kinds are stated, so no pass is needed to find them."""
    return layers.groupBy(key).agg(*(F.max(F.when(F.col("layer_type") == k, F.col("text"))).alias(k) for k in LAYERS))


def layer_counts(layers: DataFrame, doc: str) -> DataFrame:
    return layers.groupBy(doc).agg(*(F.count_if(F.col("layer_type") == k).alias(k) for k in LAYERS))


def uncovered(layers: DataFrame, key: str = "region_id") -> DataFrame:
    """Regions that lack a layer."""
    return layers.groupBy(key).agg(F.count_distinct("layer_type").alias("n")).where(F.col("n") < len(LAYERS))


def template(regions: DataFrame, doc: str) -> DataFrame:
    notes = F.bool_or(F.col("region_type").isin("footnote", "margin_note"))
    return regions.groupBy(doc).agg(F.count("*").alias("n_regions"), F.when(F.count("*") > 400, "memoir").when(notes, "reledpar").otherwise("article").alias("template"))


def latex_body(regions: DataFrame, doc: str = "doc_id", source_language: str = "eng", template_name: Column | None = None, escape_twice: bool = True) -> DataFrame:
    """``doc``, ``body``: the document's regions as LaTeX, in order.

    A footnote waits for the next paragraph that isn't set in parallel columns
    and is flushed into it; those left at the end follow the text, escaped a
    second time as in use unless ``escape_twice`` is off.
    ``regions``: ``doc, seq, region_type, diplomatic, normalized, translation``.
    """
    t = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    r = regions.select(doc, "seq", "region_type", t("diplomatic").alias("d"), t("normalized").alias("n"), t("translation").alias("tr"), (template_name if template_name is not None else F.lit("article")).alias("tpl"))
    r = r.where("n <> '' or d <> ''").where(F.col("region_type") != "running_title").withColumn("b", F.when(F.col("n") != "", F.col("n")).otherwise(F.col("d")))
    r = r.withColumns({"tb": tex(F.col("b")), "tt": tex(F.col("tr"))})  # each escaped once, used in many branches
    note = F.when((F.col("d") != "") & (F.col("n") != "") & differs(F.col("d"), F.col("n")), F.concat(F.lit("\\footnote{Diplomatic: "), tex(F.col("d")), F.lit("}"))).otherwise("")
    columns = (F.col("tpl") == "reledpar") & (F.lit(source_language) != "eng") & (F.col("tr") != "")
    flows = F.col("region_type").isin(*FLOWING) & ~columns
    r = r.withColumns({"note": note, "columns": F.col("region_type").isin(*FLOWING) & columns, "flush": F.when(flows, F.col("seq"))})
    ahead = Window.partitionBy(doc).orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    r = r.withColumn("to", F.first("flush", ignorenulls=True).over(ahead))
    is_note = F.col("region_type") == "footnote"
    # a paragraph stands last among the rows that wait for it
    waiting = Window.partitionBy(doc, "to").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    notes = F.collect_list(F.when(is_note, F.concat(F.lit("\\footnote{[Author's note] "), F.col("tb"), F.lit("}")))).over(waiting)
    r = r.withColumn("inline", F.when(F.col("flush").isNotNull(), F.array_join(notes, "")))
    command = lambda name: F.concat(F.lit(f"\\{name}{{"), F.col("tb"), F.lit("}"))
    pairs = F.concat(F.lit("\\begin{pairs}\n\\begin{Leftside}\n\\pstart "), F.col("tb"), F.col("note"), F.lit(" \\pend\n\\end{Leftside}\n\\begin{Rightside}\n\\pstart "), F.col("tt"), F.lit(" \\pend\n\\end{Rightside}\n\\Columns\n\\end{pairs}"))
    kind = F.col("region_type")
    line = (
        F.when(kind == "heading", command("section")).when(kind == "subheading", command("subsection")).when(kind == "margin_note", command("marginnote")).when(kind == "caption", command("caption"))
        .when(F.col("columns"), pairs).when(kind.isin(*FLOWING), F.concat(F.col("tb"), F.col("note"), F.coalesce("inline", F.lit("")), F.lit("\n"))).otherwise(F.concat(F.col("tb"), F.lit("\n")))
    )
    trailing = F.concat(F.lit("\\footnote{[Author's note] "), tex(F.col("tb")) if escape_twice else F.col("tb"), F.lit("}"))
    late = is_note & F.col("to").isNull()
    out = r.where(~is_note | late).select(doc, late.cast("int").alias("late"), "seq", F.when(late, trailing).otherwise(line).alias("line"))
    return out.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_list(F.struct("late", "seq", "line"))).getField("line"), "\n").alias("body"))


# What a file of each template begins with (class, packages and settings in order), and what stands around its title.
_FONTS = ("[T1]{fontenc}", "[utf8]{inputenc}", "{lmodern}")
HEADS = {
    "article": ("[12pt]{article}", (*_FONTS, "{microtype}", "{csquotes}", "[margin=1in]{geometry}", "{setspace}", "\\onehalfspacing", "{marginnote}"), ("\\maketitle",)),
    "memoir": ("[12pt,oneside]{memoir}", (*_FONTS, "{microtype}", "{csquotes}", "{marginnote}"), ("\\frontmatter", "\\maketitle", "\\mainmatter")),
    "reledpar": ("[12pt]{article}", (*_FONTS, "{reledpar}", "{reledmac}", "{csquotes}", "[margin=1in]{geometry}"), ("\\maketitle",)),
}


def _head(name: str) -> tuple[str, str]:
    """A template's lines before the title's data and after it."""
    of_class, lines, title = HEADS[name]
    before = [f"\\documentclass{of_class}", *(x if x.startswith("\\") else f"\\usepackage{x}" for x in lines), "", ""]
    return "\n".join(before), "\n".join(["\\begin{document}", *title, ""])


def rendered(documents: DataFrame, bodies: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Whole LaTeX files: ``doc``, ``latex``.  ``documents``: ``doc, title, author`` (a name or an array of names), ``template`` and, if it has one, ``year``."""
    pick = lambda n: F.element_at(F.create_map(*(F.lit(x) for k in HEADS for x in (k, _head(k)[n]))), F.coalesce("template", F.lit("article")))
    author = F.array_join("author", " and ") if documents.schema["author"].dataType.typeName() == "array" else F.col("author")
    year = F.coalesce(F.col("year").cast("string"), F.lit("")) if "year" in documents.columns else F.lit("")
    title = F.when(nonempty(F.col("title")), F.col("title")).otherwise("Untitled")
    data = F.concat(F.lit("\\title{"), tex(title), F.lit("}\n\\author{"), tex(F.coalesce(author, F.lit(""))), F.lit("}\n\\date{"), year, F.lit("}\n"))
    return documents.join(bodies, doc).select(doc, F.concat(pick(0), data, pick(1), F.col("body"), F.lit("\n\\end{document}\n")).alias("latex"))


def file_name(title: Column) -> Column:
    """A safe file stem of at most 120 characters."""
    return F.substring(F.regexp_replace(title, r"[^a-zA-Z0-9_\-]", "_"), 1, 120)
