"""Sources: directories of text documents, declared JSON and CSV files, YAML dimensions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = (
    "source_file string, file_type string, text string, char_count int, paragraph_chars int, table_chars int, table_count int, "
    "textbox_count int, textbox_chars int, warnings string"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()


def read_docx(content: bytes) -> dict:
    """Text and diagnostics of a word-processor file: text boxes first, then paragraphs and tables in document order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    boxes = list(dict.fromkeys(t for b in body.iter(f"{_W}txbxContent") for p in b.iter(f"{_W}p") if (t := _text(p))))
    inside = {id(n) for b in body.iter(f"{_W}txbxContent") for n in b.iter()}
    paragraphs: list[str] = []
    flow, table_chars, tables = [], 0, 0
    for child in body:
        if child.tag == f"{_W}tbl":
            tables += 1
            for row in child.iter(f"{_W}tr"):
                cells = list(dict.fromkeys(t for c in row.findall(f"{_W}tc") if (t := _text(c))))
                if cells:
                    flow.append(" | ".join(cells))
                    table_chars += len(flow[-1])
        elif child.tag == f"{_W}p":
            t = "".join(x.text or "" for x in child.iter(f"{_W}t") if id(x) not in inside).strip()
            if t:
                flow.append(t)
                paragraphs.append(t)
    return {
        "text": "\n".join([*boxes, *flow]),
        "paragraph_chars": sum(map(len, paragraphs)),
        "table_chars": table_chars,
        "table_count": tables,
        "textbox_count": len(boxes),
        "textbox_chars": sum(map(len, boxes)),
    }


def read_text(content: bytes) -> dict:
    """A plain text file."""
    text = content.decode("utf-8", errors="replace")
    return {"text": text, "paragraph_chars": len(text), "table_chars": 0, "table_count": 0, "textbox_count": 0, "textbox_chars": 0}


READERS: dict[str, Callable[[bytes], dict]] = {"docx": read_docx, "txt": read_text}


def scan_directory(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """One report row per file of a known type; a file that cannot be read gives an empty text and a warning."""
    known = readers or READERS
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "content")
        .withColumn("file_type", F.lower(F.regexp_extract("source_file", r"\.([^.]+)$", 1)))
        .filter(F.col("file_type").isin(*known))
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, kind, content in zip(pdf["source_file"], pdf["file_type"], pdf["content"]):
                row = {"source_file": name, "file_type": kind, "warnings": None}
                try:
                    row |= known[kind](bytes(content))
                except Exception as e:  # one bad file must not end the scan
                    row |= {"text": "", "warnings": f"{type(e).__name__}: {e}"[:200]}
                row["char_count"] = len(row["text"])
                rows.append(row)
            columns = re.findall(r"(\w+) \w+(?:,|$)", REPORT)
            yield pd.DataFrame(rows).reindex(columns=columns)

    return files.mapInPandas(extract, REPORT)


def read_records(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Nested JSON records by a declared schema; records that do not fit keep their text in ``_corrupt``.

    ``multi_line``: files hold a list of records; otherwise one record a line.
    """
    return (
        spark.read.schema(f"{schema}, _corrupt string")
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header by a declared schema."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_dimension(spark: SparkSession, path: str, schema: str, rows_of: Callable[[object], list[tuple]]) -> DataFrame:
    """A small YAML dimension (read on the driver) as a frame; ``rows_of`` turns the document into rows."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(rows_of(yaml.safe_load(f)), schema)
