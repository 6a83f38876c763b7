"""Documents from files and pages: text, DOCX and PDF by suffix, HTML."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text, normalize_url, strip
from ..operators.generate import Backends, or_else

#: Suffixes that are read, and elements without content.
SUFFIXES = (".pdf", ".docx", ".txt")
DROPPED = ("script", "style", "noscript", "svg", "iframe", "nav", "footer", "header", "aside")


def roots(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Of paths those that exist, once each, without those below another one, in order."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for p in [paths] if isinstance(paths, str) else paths:
        at = jvm.Path(p)
        store = at.getFileSystem(conf)
        if store.exists(at):
            found.add(store.makeQualified(at).toString())
    return sorted(p for p in found if not any(p.startswith(q.rstrip("/") + "/") for q in found))


def collect_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content of the supported files among paths and below folders, each once; what is missing is skipped."""
    there = roots(spark, paths)
    if not there:
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    return files.filter(F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1).isin(*SUFFIXES)).select("path", "content")


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path of the same files, sorted; contents are not read."""
    return collect_files(spark, paths).select("path").orderBy("path")


def docx_text(content: bytes) -> str:
    """Texts of the paragraphs of the body, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    said = {f"{space}tab": "\t", f"{space}br": "\n"}
    body = root.find(f"{space}body")
    return "\n".join("".join(x.text or "" if x.tag == f"{space}t" else said.get(x.tag, "") for x in p.iter()) for p in body.findall(f"{space}p"))


def pdf_blocks(content: bytes) -> str:
    """Pages' text blocks from top to bottom, then from left to right, by PyMuPDF."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pages:
        found = [sorted(p.get_text("blocks"), key=lambda b: (round(b[1], 1), round(b[0], 1))) for p in pages]
        return "\n\n".join("\n".join(str(b[4]).strip() for b in page if str(b[4]).strip()) for page in found)


def pdf_pages(content: bytes) -> str:
    """Pages' texts by pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs PyMuPDF or pypdf") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def pdf_text(content: bytes) -> str:
    """Blocks, or, whatever fails there, pages."""
    try:
        return pdf_blocks(content)
    except Exception:  # noqa: BLE001 - a missing package and a broken file alike
        return pdf_pages(content)


def _raw_text(name: str, content: bytes) -> str:
    suffix = "." + name.lower().rsplit(".", 1)[-1]
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file: {name}")
    return content.decode("utf-8", "ignore") if suffix == ".txt" else docx_text(content) if suffix == ".docx" else pdf_text(content)


def read_documents(files: DataFrame, decode_cyrillic: bool = True) -> DataFrame:
    """path, text of files (path, content): read by suffix and normalised; another suffix is an error."""

    @F.pandas_udf("string")
    def raw(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([_raw_text(p, bytes(c)) for p, c in zip(path, content, strict=True)], dtype=object)

    return files.select("path", normalize_text(raw("path", "content"), decode_cyrillic).alias("text"))


def uploaded_texts(files: DataFrame) -> DataFrame:
    """files (file_name, content, and more) with text in place of content: an upload is read by what stands behind the last point of its name, one without a name as text.

    Another suffix, and a file without text, are errors where they are read; a null content is an empty one.
    """
    name = F.coalesce(F.nullif("file_name", F.lit("")), F.lit("file.txt"))

    @F.pandas_udf("string")
    def raw(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([_raw_text(p, bytes(c or b"")) for p, c in zip(path, content, strict=True)], dtype=object)

    text = normalize_text(raw(name, F.col("content")))
    rows = files.withColumn("text", text).drop("content")
    wrong = F.raise_error(F.concat(F.lit("no text in "), name)).cast("string")
    return rows.withColumn("text", F.when(strip(F.col("text")) == "", wrong).otherwise(F.col("text")))


def unescaped(c: Column) -> Column:
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def html_title(html: Column, fallback: Column | str = "untitled") -> Column:
    """The og:title, else the title element, else the fallback."""
    name, content = r"""[^>]+property=["']og:title["']""", r"""[^>]+content=(?:"([^"]*)"|'([^']*)')"""
    either = lambda pattern: F.concat(F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2))
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    found = (either(f"(?is)<meta{name}{content}"), either(f"(?is)<meta{content}{name}"), title)
    pick = [F.when(strip(x) != "", strip(unescaped(x))) for x in found]
    return F.coalesce(*pick, fallback if isinstance(fallback, Column) else F.lit(fallback))


class _Text(HTMLParser):
    """Texts of a page, without those in a dropped element; a text of white space only is a line end or a space."""

    VOID = frozenset(("link", "meta", "br", "img", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track", "param"))
    KEPT = frozenset(("pre", "textarea"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.data = [], [], []

    def close_text(self):
        text = "".join(self.data)
        self.data = []
        if text and not any(t in DROPPED for t in self.open):
            blank = not text.strip(" \n\t\f\r") and not any(t in self.KEPT for t in self.open)
            self.parts.append(("\n" if "\n" in text else " ") if blank else text)

    def handle_starttag(self, tag, attrs):
        self.close_text()
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.close_text()

    def handle_endtag(self, tag):
        self.close_text()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.close_text()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        self.data.append(data)


def html_text(html: str) -> str:
    """Text of a page: its texts as lines, at most one blank line between them, without the elements that hold no content."""
    p = _Text()
    p.feed(html or "")
    p.close()
    p.close_text()
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(p.parts))).strip()


#: The name that it has had.
parsed_html_text = html_text


def preclean_html(html: Column) -> Column:
    """html_text as a Column: a parser in Arrow batches, as patterns cannot tell nested elements apart. Null stays null."""

    @F.pandas_udf("string")
    def text(h: pd.Series) -> pd.Series:
        return h.map(html_text, na_action="ignore")

    return text(html)


def page_documents(pages: DataFrame) -> DataFrame:
    """url, title, text of fetched pages (url, html); a page without a title has its path."""
    path = F.coalesce(F.nullif(F.regexp_replace(F.parse_url("url", F.lit("PATH")), "^/+|/+$", ""), F.lit("")), F.lit("untitled"))
    return pages.select("url", html_title(F.col("html"), path).alias("title"), preclean_html(F.col("html")).alias("text"))


@dataclass(frozen=True)
class FetchConfig:
    """How pages are fetched: `get` takes a URL, headers and a timeout, and gives (status, content type, text)."""

    timeout: float = 20.0
    retries: int = 2
    backoff: float = 1.2
    user_agent: str = "Mozilla/5.0 (compatible; folioforge)"
    get: Callable[[str, dict, float], tuple[int, str, str]] | None = None


def _get(url: str, headers: dict, timeout: float) -> tuple[int, str, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        return e.code, e.headers.get("Content-Type", ""), ""


def fetched(url: str, config: FetchConfig) -> tuple[int | None, str, str]:
    """(status, content type, text); a call that fails, or has a status from 400 on, is made again after a growing pause. The last failure has a null status."""
    for n in range(config.retries + 1):
        try:
            status, kind, text = (config.get or _get)(url, {"User-Agent": config.user_agent}, config.timeout)
            if status < 400:
                return status, kind, text
        except Exception:  # noqa: BLE001 - whatever the network does, the next try may do better
            pass
        if n < config.retries:
            time.sleep(config.backoff * 2**n)
    return None, "", ""


def fetch_pages(urls: DataFrame, config: FetchConfig = FetchConfig()) -> DataFrame:
    """url (normalised), status, content_type, html of urls (url), one request after another in each task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [(u, *fetched(u, config)) for u in b["url"]]
            out = pd.DataFrame(rows, columns=["url", "status", "content_type", "html"])
            yield out.astype({"status": "Int32"})

    return urls.select(normalize_url(F.col("url")).alias("url")).mapInPandas(run, "url string, status int, content_type string, html string")


def parsed_pages(fetched_: DataFrame, backends: Backends | None = None) -> DataFrame:
    """url, title, text, status, content_type, error of fetch_pages: precleaned texts, refined by a model where one is given.

    A page that could not be fetched or is no HTML has an error and no text. A model gets the first 60,000 characters;
    where it fails, the precleaned text stays.
    """
    path = F.coalesce(F.nullif(F.regexp_replace(F.parse_url("url", F.lit("PATH")), "^/+|/+$", ""), F.lit("")), F.lit("untitled"))
    error = F.when(F.col("status").isNull(), F.concat(F.lit("failed to fetch "), F.col("url"))).when(~F.lower("content_type").contains("html"), F.concat(F.lit("not an HTML page: "), F.col("content_type")))
    rows = fetched_.withColumn("error", error)
    rows = rows.withColumn("title", F.when(F.col("error").isNull(), html_title(F.col("html"), path))).withColumn("text", F.when(F.col("error").isNull(), preclean_html(F.col("html"))))
    if backends is not None:
        prompt = F.concat(F.lit("Keep the content of this page as structured text, add nothing.\nURL: "), F.col("url"), F.lit("\n\n"), F.substring("text", 1, 60_000))
        rows = or_else(rows, prompt, F.col("text"), "refined", backends).withColumn("text", F.when(F.col("text").isNotNull(), F.col("refined")))
    return rows.select("url", "title", "text", "status", "content_type", "error")


def page_sources(pages: DataFrame) -> DataFrame:
    """url, source_name, text for the index: pages with a text, under a header; the source is named by the title, else by the URL. A page's extension list does not hold here."""
    text = F.concat(F.lit("URL: "), F.col("url"), F.lit("\nTITLE: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("text"))
    named = F.coalesce(F.nullif("title", F.lit("")), "url")
    return pages.filter(strip(F.coalesce("text", F.lit(""))) != "").select("url", named.alias("source_name"), normalize_text(text).alias("text"))
