"""PDFs and images to units: the extraction is a protocol, the layout of its results is fixed here."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGE_CONFIDENCE, TABLE_CONFIDENCE, OCR_CONFIDENCE, MOST_CELLS = 0.92, 0.86, 0.72, 600
UNIT = "doc_id string, pos int, source_type string, content string, section_path string, confidence double"


class Extractor(Protocol):
    def pages(self, raw: bytes, path: str) -> list[dict]:
        """For each page {text, tables: [[[cell]]], ocr}: ocr is the text read from the picture where there is no other."""


def read_binaries(spark: SparkSession, paths: list[str], extractor: Extractor) -> DataFrame:
    """Units of page texts (page/N/text), table cells (page/N/table/T/rRcC, at most 600 a page) and, for pages without text, of read pictures (page/N/ocr).

    A page that fails is skipped by the extractor; files are read in tasks, one row each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, raw in zip(b["path"], b["content"]):
                doc = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                mine: list[tuple] = []
                for n, page in enumerate(extractor.pages(bytes(raw), path), 1):
                    if (page.get("text") or "").strip():
                        mine.append(("text_sentence", page["text"].strip(), f"page/{n}/text", PAGE_CONFIDENCE))
                    elif (page.get("ocr") or "").strip():
                        mine.append(("ocr_text", page["ocr"].strip(), f"page/{n}/ocr", OCR_CONFIDENCE))
                    cells = [(f"page/{n}/table/{t}/r{r}c{c}", str(cell).strip()) for t, table in enumerate(page.get("tables") or [], 1) for r, row in enumerate(table, 1) for c, cell in enumerate(row, 1) if str(cell or "").strip()]
                    mine += [("table_cell", text, section, TABLE_CONFIDENCE) for section, text in cells[:MOST_CELLS]]
                rows += [(doc, i, kind, text, section, conf) for i, (kind, text, section, conf) in enumerate(mine)]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "source_type", "content", "section_path", "confidence"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, UNIT)
