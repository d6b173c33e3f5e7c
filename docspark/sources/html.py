"""Web pages as layout blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML tag to block type.
TAGS = {"h1": "title", "h2": "title", "h3": "title", "p": "text", "li": "list", "nav": "header", "footer": "footer", "table": "table"}


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_key, content): each page as the JSON of a content list.  Tags may be left open; scripts and styles are skipped."""

    def parse(batches):
        import json
        from html.parser import HTMLParser

        import pyarrow as pa

        class Blocks(HTMLParser):
            def __init__(self):
                super().__init__()
                self.blocks, self.kind, self.parts, self.skip, self.level = [], None, [], 0, 1

            def close_block(self):
                text = " ".join("".join(self.parts).split())
                if self.kind and text:
                    level = {"text_level": self.level} if self.kind == "title" else {}
                    self.blocks.append({"type": self.kind, "text": text, "page_idx": 0} | level)
                self.kind, self.parts = None, []

            def handle_starttag(self, tag, attrs):
                if tag in ("script", "style"):
                    self.skip += 1
                elif tag in TAGS:
                    self.close_block()
                    self.kind = TAGS[tag]
                    if tag[0] == "h" and tag[1:].isdigit():
                        self.level = int(tag[1:])

            def handle_endtag(self, tag):
                if tag in ("script", "style"):
                    self.skip = max(0, self.skip - 1)
                elif tag in TAGS:
                    self.close_block()

            def handle_data(self, data):
                if not self.skip and self.kind:
                    self.parts.append(data)

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                reader = Blocks()
                try:
                    reader.feed(text or "")
                    reader.close()
                except Exception:  # noqa: BLE001  what was read so far is kept
                    pass
                reader.close_block()
                out.append(json.dumps(reader.blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_key", "content"])

    slim = pages.select(F.col(key).cast("string").alias("doc_key"), F.col(html).alias("html"))
    return slim.mapInArrow(parse, "doc_key string, content string")
