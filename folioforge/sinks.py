"""Results as CSV, JSON, HTML, XLSX, PPTX and WAV, by the standard library only."""

from __future__ import annotations

import csv
import html
import io
import json
import wave
import zipfile
from array import array
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_csv(columns: list[str], rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows([columns, *rows])
    return out.getvalue()


def table_json(title: str, columns: list[str], rows: list[list[str]]) -> str:
    return json.dumps({"title": title, "columns": columns, "rows": rows}, ensure_ascii=False, indent=2)


def table_file(table: dict, kind: str = "json") -> tuple[bytes, str]:
    """A table (title, columns, rows) as CSV or XLSX, and as JSON for any other kind; and its media type."""
    title, columns, rows = table["title"], list(table["columns"]), [list(r) for r in table["rows"]]
    if kind == "csv":
        return table_csv(columns, rows).encode(), "text/csv"
    if kind == "xlsx":
        return table_xlsx(title, columns, rows), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
    return table_json(title, columns, rows).encode(), "application/json"


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()


def _rels(rows: list[tuple[str, str, str]]) -> str:
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{base}{t}" Target="{to}"/>' for i, t, to in rows) + "</Relationships>"


def _types(parts: dict[str, str]) -> str:
    return '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in parts.items()) + "</Types>"


def table_xlsx(title: str, columns: list[str], rows: list[list[str]]) -> bytes:
    """One sheet, named by the first 31 characters of the title."""
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in r) + "</row>" for r in [columns, *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zipped({
        "[Content_Types].xml": _types({"/xl/workbook.xml": "spreadsheetml.sheet.main", "/xl/worksheets/sheet1.xml": "spreadsheetml.worksheet"}),
        "_rels/.rels": _rels([("r1", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(title[:31] or "Table", {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels([("r1", "worksheet", "worksheets/sheet1.xml")]),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>',
    })


_NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_TREE = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'


def _theme() -> str:
    """The colours, fonts and formats that a slide master must refer to."""
    tones = {"dk1": "0F172A", "lt1": "FFFFFF", "dk2": "1E293B", "lt2": "CBD5E1", "accent1": "6366F1", "accent2": "10B981", "accent3": "F59E0B", "accent4": "EF4444", "accent5": "3B82F6", "accent6": "8B5CF6", "hlink": "2563EB", "folHlink": "7C3AED"}
    colours = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in tones.items())
    font = '<a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill, line, effect = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln w="9525"><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>', "<a:effectStyle><a:effectLst/></a:effectStyle>"
    formats = f"<a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst>"
    return f'<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="Plain"><a:themeElements><a:clrScheme name="Plain">{colours}</a:clrScheme><a:fontScheme name="Plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="Plain">{formats}</a:fmtScheme></a:themeElements></a:theme>'


def slides_pptx(title: str, slides: list[tuple[str, list[str]]]) -> bytes:
    """A title slide and one for each (title, bullets), on one master and one layout."""

    def box(n: int, lines: list[str], y: int, h: int) -> str:
        text = "".join(f"<a:p><a:r><a:rPr lang=\"en-US\"/><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines) or "<a:p/>"
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="Text {n}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="600000" y="{y}"/><a:ext cx="10800000" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr wrap="square"/><a:lstStyle/>{text}</p:txBody></p:sp>'

    pages = [(title, []), *slides]
    numbers = range(1, len(pages) + 1)
    kinds = {"/ppt/presentation.xml": "presentationml.presentation.main", "/ppt/slideMasters/slideMaster1.xml": "presentationml.slideMaster", "/ppt/slideLayouts/slideLayout1.xml": "presentationml.slideLayout", "/ppt/theme/theme1.xml": "theme"}
    colours = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"'
    files = {
        "[Content_Types].xml": _types(kinds | {f"/ppt/slides/slide{i}.xml": "presentationml.slide" for i in numbers}),
        "_rels/.rels": _rels([("r1", "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": f'<p:presentation {_NS}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="m1"/></p:sldMasterIdLst><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in numbers) + '</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _rels([("m1", "slideMaster", "slideMasters/slideMaster1.xml"), ("t1", "theme", "theme/theme1.xml"), *((f"r{i}", "slide", f"slides/slide{i}.xml") for i in numbers)]),
        "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster {_NS}><p:cSld><p:bg><p:bgRef idx="1001"><a:schemeClr val="bg1"/></p:bgRef></p:bg><p:spTree>{_TREE}</p:spTree></p:cSld><p:clrMap {colours}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="l1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _rels([("l1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("t1", "theme", "../theme/theme1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": f'<p:sldLayout {_NS} type="blank"><p:cSld name="Blank"><p:spTree>{_TREE}</p:spTree></p:cSld><p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _rels([("m1", "slideMaster", "../slideMasters/slideMaster1.xml")]),
        "ppt/theme/theme1.xml": _theme(),
    }
    for i, (head, bullets) in enumerate(pages, 1):
        files[f"ppt/slides/slide{i}.xml"] = f"<p:sld {_NS}><p:cSld><p:spTree>{_TREE}{box(2, [head], 400000, 1200000)}{box(3, bullets, 1800000, 4400000)}</p:spTree></p:cSld><p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sld>"
        files[f"ppt/slides/_rels/slide{i}.xml.rels"] = _rels([("l1", "slideLayout", "../slideLayouts/slideLayout1.xml")])
    return _zipped(files)


def graph_html(title: str, nodes: list[dict], edges: list[dict]) -> str:
    """The page of graph_page for nodes (label, value) and edges (from, to, value)."""
    return graph_page(title, {"nodes": nodes, "edges": edges})[0]


def graph_page(title: str, graph: str | dict) -> tuple[str, int, int]:
    """A page that holds a graph (see concepts.payload) as JSON and lists it; its numbers of nodes and edges."""
    held = json.loads(graph) if isinstance(graph, str) else graph
    data = json.dumps(held, ensure_ascii=False).replace("</", "<\\/")
    page = f"""<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>
<body><h1>{html.escape(title)}</h1><p id="s"></p><ul id="n"></ul><ul id="g"></ul>
<script>const g = {data};
const put = (id, text, tip) => {{ const l = document.createElement("li"); l.textContent = text; l.title = tip || ""; document.getElementById(id).append(l) }};
document.getElementById("s").textContent = (g.meta || {{}}).summary || "";
for (const n of g.nodes) put("n", n.label + " (" + n.value + ")", n.summary);
for (const e of g.edges) put("g", e.from + " - " + e.to + " (" + e.value + ")", e.title);
</script></body></html>"""
    return page, len(held["nodes"]), len(held["edges"])


def spoken_wav(segments: list[tuple[int, str, str]], voices: Callable[[int, str], list[float] | None], rate: int = 48_000) -> bytes | None:
    """A dialogue's segments (speaker, text, what speech falls back on) as WAV, null if none could be spoken.

    A voice takes speaker and text and gives samples; a text that it fails on is tried again in its plainer form, and a
    segment that fails twice is left out.
    """
    said = []
    for speaker, text, plain in segments:
        for t in (text, plain):
            if not t.strip():
                continue
            try:
                if (samples := voices(speaker, t)) is not None:
                    said.append(samples)
                    break
            except Exception:  # noqa: BLE001 - whatever a voice raises, the plainer text is next
                continue
    made = wav(said, rate) if said else b""
    return made if len(made) > 44 else None


def audio_files(segments: DataFrame, key: str, voices: Callable[[int, str], list[float] | None], rate: int = 48_000) -> DataFrame:
    """key, file, audio of dialogues' segments (key, line_no, speaker, text, spoken): a WAV each, under a name of 12 hex digits of the key's hash; dialogues that none could speak have none."""
    one = F.struct("line_no", "speaker", "text", "spoken")
    rows = segments.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("lines"))

    @F.pandas_udf("binary")
    def speak(lines: pd.Series) -> pd.Series:
        return lines.map(lambda ls: spoken_wav([(r["speaker"], r["text"], r["spoken"]) for r in ls], voices, rate))

    name = F.concat(F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 12), F.lit(".wav"))
    rows = rows.select(key, speak("lines").alias("audio"))
    return rows.select(key, F.when(F.col("audio").isNotNull(), name).alias("file"), "audio")


def wav(segments: list[list[float]], rate: int = 48_000, pause: float = 0.14) -> bytes:
    """Segments of samples in [-1, 1], each with a pause behind, as 16-bit mono."""
    samples = array("h")
    for s in segments:
        samples.extend(int(max(-1.0, min(1.0, x)) * 32767) for x in s)
        samples.extend([0] * int(pause * rate))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.tobytes())
    return out.getvalue()
