"""Rulebooks from spreadsheets and text documents, without office libraries.

Files are read by Spark as binary rows; a pandas stage unzips each and yields its cells in long
form; everything after that is DataFrame code, except the parser of the logic strings.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rule_logic

CELLS = "path string, sheet string, sheet_no int, row int, col int, value string"

# XML namespaces of the formats.
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

# Header cells by role.
TABULAR = {
    "topic": ("topic",), "sub": ("sub-topic", "subtopic"), "question": ("prompt question", "subtopic question"), "answer": ("answer type", "answer options"),
    "example": ("customer example languge", "customer example language"), "logic": ("deployment logic",),
}
NARRATIVE = {"topic": ("section/topic",), "issue": ("customer issue/request",), "response": ("approvals/notes/responses",), "owner": ("escalation owner(s)",)}
PAIRED = {"topic": "topic", "sources": "sources", "desirable": "desirable sample clause", "undesirable": "undesirable sample clause"}
PAIRED_RULE = " rule"  # ends the header of the rules
HEADER_ROWS = {"tabular": 5, "narrative": 6}


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """(sheet, sheet number, row, column, value) of every non-empty cell; rows and columns from 1."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")):
            target = targets[sheet.get(_R)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in root.iter(_S + "row"):
                for cell in row.iter(_S + "c"):
                    kind, v = cell.get("t"), cell.find(_S + "v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(_S + "t"))
                    elif v is None:
                        continue
                    else:
                        value = shared[int(v.text)] if kind == "s" else v.text or ""
                    if value:
                        yield sheet.get("name"), k, int(row.get("r")), _column_number(cell.get("r")), value


def document_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """The cells of every table of a text document, a table as a sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for k, table in enumerate(root.iter(_W + "tbl")):
        for r, row in enumerate(table.findall(_W + "tr"), 1):
            for c, cell in enumerate(row.findall(_W + "tc"), 1):
                text = "\n".join("".join(t.text or "" for t in p.iter(_W + "t")) for p in cell.findall(_W + "p")).strip()
                if text:
                    yield f"table {k}", k, r, c, text


def _put(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """A zip archive of texts, written through Spark's file systems."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data.getvalue())
    finally:
        out.close()


def write_workbook(spark: SparkSession, path: str, sheets: dict[str, list[list[str | None]]]) -> None:
    """A small .xlsx file, as a person would fill it in; rows are on the driver."""

    def body(rows: list[list[str | None]]) -> str:
        out = []
        for r, row in enumerate(rows, 1):
            made = "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row, 1) if v)
            out.append(f'<row r="{r}">{made}</row>')
        return f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{"".join(out)}</sheetData></worksheet>'

    space, kind = _R[1 : _R.index("}")], "http://schemas.openxmlformats.org/package/2006/relationships"
    names = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    parts = {"xl/workbook.xml": f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{space}"><sheets>{names}</sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kind}">{links}</Relationships>'}
    _put(spark, path, parts | {f"xl/worksheets/sheet{k}.xml": body(rows) for k, rows in enumerate(sheets.values(), 1)})


def write_document(spark: SparkSession, path: str, tables: list[list[list[str | None]]]) -> None:
    """A small .docx file of tables; rows are on the driver."""
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{escape(v or '')}</w:t></w:r></w:p></w:tc>"
    body = "".join("<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, row))}</w:tr>" for row in rows) + "</w:tbl>" for rows in tables)
    _put(spark, path, {"word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>'})


def cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the files at ``path`` (a file, folder or pattern); .xlsx and .docx only."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if not name.endswith((".xlsx", ".docx")):
                    raise ValueError(f"neither .xlsx nor .docx: {name}")
                found = workbook_cells(content) if name.endswith(".xlsx") else document_cells(content)
                yield pd.DataFrame([(name, *c) for c in found], columns=["path", "sheet", "sheet_no", "row", "col", "value"])

    return files.mapInPandas(read, CELLS)


def _roles(table: DataFrame, roles: dict[str, tuple[str, ...]], least: list[str] | int, first_rows: int) -> DataFrame:
    """(path, sheet, header, role, col): the first row of a sheet that has enough of the headers."""
    name = F.lower(F.trim("value"))
    role = F.lit(None).cast("string")
    for key, names in roles.items():
        role = F.when(name.isin(*names), key).otherwise(role)
    found = table.filter(F.col("row") <= first_rows).withColumn("role", role)
    if roles is NARRATIVE:
        found = found.withColumn("role", F.when(F.startswith(name, F.lit("edits")), "edits").otherwise(F.col("role")))
    found = found.filter("role is not null").groupBy("path", "sheet", "row", "role").agg(F.min("col").alias("col"))
    whole = found.groupBy("path", "sheet", "row").agg(F.collect_set("role").alias("have"))
    enough = F.size(F.array_intersect("have", F.array(*map(F.lit, least)))) == len(least) if isinstance(least, list) else F.size(F.array_except("have", F.array(F.lit("edits")))) >= least
    header = whole.filter(enough).groupBy("path", "sheet").agg(F.min("row").alias("header"))
    return found.join(header, ["path", "sheet"]).filter("row = header").drop("row")


def _rows(table: DataFrame, roles: DataFrame, names: list[str]) -> DataFrame:
    """One row per sheet row below its header, with a column per role."""
    body = table.join(roles, ["path", "sheet", "col"]).filter("row > header")
    return body.groupBy("path", "sheet", "row").agg(*(F.max(F.when(F.col("role") == n, F.col("value"))).alias(n) for n in names))


def split_options(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), ":", ";"), ";"), lambda x: F.trim(x)), lambda x: x != "")


def _provenance(place: str) -> Column:
    return F.to_json(F.struct(F.col("path").alias("file"), F.col(place), "row"))


def tabular_rules(table: DataFrame, policy_id: str, carry_forward: bool = False) -> DataFrame:
    """Rules from sheets with topic, sub-topic, question and answer columns.

    With ``carry_forward`` an empty topic, as merged cells leave it, takes the one above.
    """
    roles = _roles(table, TABULAR, ["topic", "sub", "question", "answer"], HEADER_ROWS["tabular"])
    rows = _rows(table, roles, list(TABULAR))
    if carry_forward:
        above = Window.partitionBy("path", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("topic", F.last("topic", ignorenulls=True).over(above))
    rows = rows.filter("topic is not null and sub is not null and question is not null")

    @F.pandas_udf("string")
    def first_branch(logic: pd.Series) -> pd.Series:
        return logic.map(lambda t: next((json.dumps({"predicate": b["predicate"], "answer": b["answer"]}) for b in rule_logic.parse(t) if not b["is_else"]), None))

    branch = first_branch(F.coalesce("logic", F.lit("")))
    rows = rows.withColumn("branch", branch)
    return rows.select(
        F.lit(policy_id).alias("policy_id"), F.concat_ws(" :: ", "topic", "sub").alias("title"), F.col("question").alias("description"), F.lit("cluster").alias("applies_to"),
        F.lit("warn").alias("severity"), F.get_json_object("branch", "$.predicate").alias("predicate"), F.col("example").alias("reference_text"),
        F.when(F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit("standard")), "standard_nonstandard").otherwise("yes_no").alias("answer_type"),
        split_options(F.col("answer")).alias("answer_options"), F.array("topic", "sub").alias("tags"),
        F.to_json(F.struct(F.col("path").alias("file"), "sheet", "row", F.get_json_object("branch", "$.answer").alias("answer"))).alias("source_provenance"),
        F.lit("draft").alias("status"), F.col("topic").alias("label"),
    )


def narrative_rules(table: DataFrame, policy_id: str) -> DataFrame:
    """Rules from sheets of issues; a row with a topic and no issue opens a section."""
    rows = _rows(table, _roles(table, NARRATIVE, 3, HEADER_ROWS["narrative"]), [*NARRATIVE, "edits"])
    above = Window.partitionBy("path", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.last(F.when(F.col("issue").isNull(), F.col("topic")), ignorenulls=True).over(above))
    rows = rows.filter(F.col("issue").isNotNull() & (F.lower(F.trim("issue")) != "clause"))
    return rows.select(
        F.lit(policy_id).alias("policy_id"), F.concat_ws(" :: ", F.coalesce("section", "sheet"), F.substring("issue", 1, 80)).alias("title"), F.col("issue").alias("description"),
        F.lit("cluster").alias("applies_to"), F.when(F.contains(F.lower(F.coalesce("response", F.lit(""))), F.lit("approval required")), "approval_required").otherwise("warn").alias("severity"),
        F.col("issue").alias("nl_assertion"), F.col("edits").alias("preferred_language"), F.col("owner").alias("escalation_owner"), F.col("response").alias("rationale"),
        F.array("sheet", F.coalesce("section", F.lit(""))).alias("tags"), _provenance("sheet").alias("source_provenance"), F.lit("draft").alias("status"), F.col("section").alias("label"),
    )


def paired_rules(table: DataFrame, policy_id: str) -> DataFrame:
    """Rules from document tables of desirable and undesirable clauses."""
    name = F.lower(F.trim("value"))
    role = F.lit(None).cast("string")
    for key, start in PAIRED.items():
        role = F.when(F.startswith(name, F.lit(start)), key).otherwise(role)
    role = F.when(F.endswith(name, F.lit(PAIRED_RULE)), "rule").otherwise(role)
    roles = table.filter("row = 1").withColumn("role", role).filter("role is not null").groupBy("path", "sheet", "role").agg(F.min("col").alias("col"))
    whole = roles.groupBy("path", "sheet").agg(F.count("*").alias("k")).filter(F.col("k") == len(PAIRED) + 1).select("path", "sheet")
    rows = _rows(table, roles.join(whole, ["path", "sheet"]).withColumn("header", F.lit(1)), [*PAIRED, "rule"]).filter("rule is not null")
    topic = F.coalesce("topic", F.lit(""))
    return rows.select(
        F.lit(policy_id).alias("policy_id"), F.when(topic != "", F.substring(topic, 1, 80)).otherwise(F.concat(F.lit("Rule "), F.col("row").cast("string"))).alias("title"),
        F.col("rule").alias("description"), F.lit("cluster").alias("applies_to"), F.lit("warn").alias("severity"), F.col("rule").alias("nl_assertion"),
        F.col("desirable").alias("reference_text"), F.col("undesirable").alias("walkaway_language"), F.col("sources").alias("rationale"), F.lit(0.85).alias("similarity_threshold"),
        F.array(topic).alias("tags"), _provenance("sheet").alias("source_provenance"), F.lit("draft").alias("status"), topic.alias("label"),
    )


def bindings(rules: DataFrame) -> DataFrame:
    """A soft binding to a cluster for each rule with a label; ``soft_rebind`` finds the cluster."""
    return rules.filter("label is not null").select("rule_id", F.lit("cluster").alias("entity_kind"), F.concat(F.lit("label:"), "label").alias("entity_id"), F.col("label").alias("label_text"), F.lit(0.5).alias("confidence"))


def import_rules(spark: SparkSession, path: str, policy_id: str) -> DataFrame:
    """Rules of a .xlsx file, tabular or else narrative, or of a .docx file."""
    if path.endswith(".docx"):
        return paired_rules(cells(spark, path), policy_id)
    if not path.endswith(".xlsx"):
        raise ValueError(f"neither .xlsx nor .docx: {path}")
    table = cells(spark, path)
    tabular = tabular_rules(table, policy_id)
    return narrative_rules(table, policy_id) if tabular.isEmpty() else tabular
