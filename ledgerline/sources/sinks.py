"""Outputs of a run: tables as CSV and JSON, the brief as Markdown, a workbook and a document."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable
from datetime import date, datetime
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.brief import headline, takeaway
from ..plans.pipeline import Run

# ---------------------------------------------------------------- projections


def clusters_flat(events: DataFrame) -> DataFrame:
    """Events with arrays as text: companies by comma, titles by semicolon."""
    names = F.when(F.size("companies") > 0, F.array_join("companies", ", ")).otherwise("Not clearly identified")
    return events.withColumns({"companies": names, "source_titles": F.array_join(F.expr("transform(sources, s -> s.title)"), "; ")}).drop("sources")


def evidence(events: DataFrame) -> DataFrame:
    """A row for each event and source."""
    return events.select("cluster_id", "canonical_headline", F.explode("sources").alias("s")).select("cluster_id", "canonical_headline", "s.*")


def brief_rows(events: DataFrame, watch: bool) -> DataFrame:
    level = F.col("confidence").isin("High", "Medium")
    flat = clusters_flat(events.where(~level if watch else level))
    return flat.select(
        "cluster_id", "canonical_headline", "deal_type", "companies", "geography", "category", "deal_value", "confidence", "relevance_score", "credibility_score", "source_count", "why_it_matters"
    )


def rejected_or_duplicate(processed: DataFrame) -> DataFrame:
    return processed.where("status = 'reject' or dedupe_status = 'duplicate'")


def cells(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Every column as text: nested ones as JSON, null and missing ones empty."""

    def cell(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)
        return F.coalesce(F.to_json(F.col(f.name)) if nested else F.col(f.name).cast("string"), F.lit(""))

    have = {f.name: f for f in df.schema}
    return df.select(*((cell(have[c]) if c in have else F.lit("")).alias(c) for c in columns or df.columns))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in any of whose columns the text occurs, in either case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c) for c in cells(df).columns))), F.lit(text.lower()))) if text else df


# ---------------------------------------------------------------- distributed writers


def write_csv(df: DataFrame, path: str) -> None:
    cells(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# ---------------------------------------------------------------- files made on the driver, of one brief


def plain(value: object) -> object:
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and value != value else value


def events_json(events: DataFrame) -> str:
    return json.dumps([plain(r.asDict(recursive=True)) for r in events.orderBy("cluster_id").collect()], indent=2, ensure_ascii=False)


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _package(path: Path, kind: str, parts: dict[str, str], types: dict[str, str], main: str) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES.format("".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{kind}.{t}+xml"/>' for p, t in types.items())))
        z.writestr("_rels/.rels", _RELS.format(f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="{main}"/>'))
        for name, text in parts.items():
            z.writestr(name, text)


def _letter(i: int) -> str:
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def _sheet(header: list[str], rows: list[list[str]]) -> str:
    widths = [min(45, max(12, 2 + max(len(str(r[i])) for r in [header, *rows[:50]]))) for i in range(len(header))]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    line = lambda n, r: f'<row r="{n}">' + "".join(f'<c r="{_letter(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(r)) + "</row>"
    body = "".join(line(n, r) for n, r in enumerate([header, *rows], 1))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_SHEETS}">{view}<cols>{cols}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:{_letter(len(header) - 1)}{len(rows) + 1}"/></worksheet>'


def write_xlsx(path: Path, sheets: dict[str, tuple[list[str], list[list[str]]]]) -> None:
    names = list(sheets)
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    parts = {"xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_SHEETS}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>'}
    parts["xl/_rels/workbook.xml.rels"] = _RELS.format("".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)))
    parts |= {f"xl/worksheets/sheet{i}.xml": _sheet(*sheets[n]) for i, n in enumerate(names, 1)}
    types = {"xl/workbook.xml": "sheet.main"} | {f"xl/worksheets/sheet{i}.xml": "worksheet" for i in range(1, len(names) + 1)}
    _package(path, "spreadsheetml", parts, types, "xl/workbook.xml")


def write_docx(path: Path, brief: dict) -> None:
    out: list[str] = []

    def add(text: str, size: int = 22, bold: bool = False) -> None:
        out.append(f'<w:p><w:r><w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{size}"/></w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>')

    shot = brief["snapshot"]
    add(brief["title"], 40, True)
    add(f"{brief['data_mode']} | {brief['date_range']} | Run: {brief['run_timestamp']}")
    add("Executive Snapshot", 30, True)
    add(f"• {shot['deal_events']} deal event(s) from {shot['article_count']} article(s) across {shot['source_count']} source(s).")
    add(f"• {brief.get('ai_executive_summary') or shot['auto_summary']}")
    for name, key in (("Top Deal Highlights", "highlights"), ("Watchlist", "watchlist")):
        add(name, 30, True)
        for e in brief[key]:
            add(headline(e), 24, True)
            add(f"{e['deal_type']} | {', '.join(e['companies']) or 'Not clearly identified'} | {e['geography']} | {e['deal_value']} | {e['confidence']} confidence")
            add(takeaway(e))
        if not brief[key]:
            add("None.")
    add("Methodology", 30, True)
    for x in brief["methodology"]:
        add(f"• {x}")
    add("Source Appendix", 30, True)
    for s in brief["source_appendix"]:
        add(f"• {s['cluster_id']} | {s['label']} | {s['title']} | {s['url']}")
    body = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_WORDS}"><w:body>{"".join(out)}</w:body></w:document>'
    _package(path, "wordprocessingml", {"word/document.xml": body}, {"word/document.xml": "document.main"}, "word/document.xml")


def _table(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    return df.columns, [list(r) for r in cells(df).collect()]


def workbook(run: Run) -> dict[str, tuple[list[str], list[list[str]]]]:
    """Seven sheets. Articles of one run are collected for the last but one: a workbook is for people to read."""
    shot, m = run.brief["snapshot"], run.metadata
    facts = {
        "Title": run.brief["title"], "Date range": run.brief["date_range"], "Run timestamp": run.brief["run_timestamp"], "Data mode": run.brief["data_mode"], "Deal events": shot["deal_events"],
        "Articles": shot["article_count"], "Sources": shot["source_count"], "Confidence mix": json.dumps(shot["confidence_counts"]), "Top categories": ", ".join(shot["top_categories"]),
        "Summary": shot["auto_summary"], "Duplicates": m["duplicate_count"],
    }
    return {
        "Executive Snapshot": (["metric", "value"], [[k, str(v)] for k, v in facts.items()]),
        "Deal Highlights": _table(brief_rows(run.events, False)),
        "Deal Clusters": _table(clusters_flat(run.events)),
        "Article Evidence": _table(evidence(run.events)),
        "Watchlist": _table(brief_rows(run.events, True)),
        "Rejected & Duplicates": _table(rejected_or_duplicate(run.processed)),
        "Methodology": (["section", "text"], [["Methodology", x] for x in run.brief["methodology"]]),
    }


def write_all(run: Run, folder: str) -> dict[str, str]:
    """All eight outputs under a local folder; the four tables are folders that Spark wrote."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    out = {}
    for name, df in (("raw_articles", run.raw), ("processed_articles", run.processed)):
        write_csv(df, out.setdefault(f"{name}.csv", str(top / f"{name}.csv")))
        write_json(df, out.setdefault(f"{name}.json", str(top / f"{name}.json")))
    (top / "deal_clusters.json").write_text(events_json(run.events))
    (top / "newsletter.md").write_text(run.markdown)
    write_docx(top / "newsletter.docx", run.brief)
    write_xlsx(top / "newsletter.xlsx", workbook(run))
    return out | {n: str(top / n) for n in ("deal_clusters.json", "newsletter.md", "newsletter.docx", "newsletter.xlsx")}
