"""Engines that turn files into content lists.  They are external; each adapter imports its own when first used.

An engine is an object with ``run(files) -> {key: JSON text}``; ``files`` maps keys to (name, bytes).  A batch is one
call.  What an engine cannot do raises, and becomes a warning of the documents concerned.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import time
from collections.abc import Callable
from contextlib import ExitStack, contextmanager
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

TIMEOUT_S = 900
TOLD_BYTES = 1 << 20  # of contents that a task of engines hands on at once


class Engine(Protocol):
    def run(self, files: dict[str, tuple[str, bytes]]) -> dict[str, str]: ...


def env_count(name: str, default: int) -> int:
    """A whole number of at least 1 from the environment, or ``default``."""
    try:
        value = int(os.environ.get(name, ""))
    except ValueError:
        return default
    return value if value >= 1 else default


def batch_size() -> int:
    return env_count("MINERU_BATCH_SIZE", env_count("DOCSPARK_BATCH_SIZE", 8))


def max_in_flight() -> int:
    return env_count("MINERU_MAX_INFLIGHT", env_count("DOCSPARK_MAX_IN_FLIGHT", 1))


@contextmanager
def in_flight(most: int):
    """Holds one of ``most`` places of this machine, waiting for it if need be; a process that dies gives its place up."""
    import fcntl

    at = Path(tempfile.gettempdir(), f"docspark-engine-{os.getuid()}")
    at.mkdir(exist_ok=True)
    with ExitStack() as stack:
        places = [stack.enter_context(open(at / str(i), "w")) for i in range(most)]
        held = None
        if len(places) == 1:  # no other place can get free meanwhile
            fcntl.flock(places[0], fcntl.LOCK_EX)
            held = places[0]
        while held is None:
            for place in places:
                try:
                    fcntl.flock(place, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    held = place
                    break
                except OSError:
                    continue
            else:
                time.sleep(0.02)
        yield


class CommandEngine:
    """An engine run as a command: ``command`` with {source} and {target} filled in writes JSON below the target."""

    def __init__(self, command: list[str]):
        self.command = command

    def run(self, files):
        out = {}
        for key, (name, content) in files.items():
            with tempfile.TemporaryDirectory() as at:
                source, target = Path(at, name), Path(at, "out")
                source.write_bytes(content)
                command = [c.format(source=source, target=target) for c in self.command]
                env = {"CUDA_VISIBLE_DEVICES": "", **os.environ}  # a graphics card is used only where it is named
                subprocess.run(command, check=True, timeout=TIMEOUT_S, capture_output=True, env=env)
                found = sorted(target.rglob("*.json"), key=lambda p: (not p.name.endswith("_content_list.json"), str(p)))
                if not found:
                    raise RuntimeError("the command left no content list")
                out[key] = found[0].read_text()
        return out


class MinerUEngine:
    """MinerU in this process: one model pass for a batch."""

    def run(self, files):
        from mineru.cli.common import do_parse, read_fn

        with tempfile.TemporaryDirectory() as at:
            names, contents = list(files), []
            for i, (name, content) in enumerate(files.values()):
                source = Path(at, f"{i}{Path(name).suffix}")
                source.write_bytes(content)
                contents.append(read_fn(source))  # pictures become pages here
            out = Path(at, "out")
            do_parse(output_dir=str(out), pdf_file_names=names, pdf_bytes_list=contents, p_lang_list=["en"] * len(names),
                     backend=os.environ.get("MINERU_BACKEND", "pipeline"), parse_method="auto", f_dump_content_list=True,
                     f_dump_md=False, f_dump_middle_json=False, f_dump_model_output=False, f_dump_orig_pdf=False,
                     f_draw_layout_bbox=False, f_draw_span_bbox=False)
            found = {p.name.removesuffix("_content_list.json"): p for p in out.rglob("*.json") if p.name.endswith("_content_list.json")}
            return {k: found[k].read_text() for k in names if k in found}


#: MinerU as a command, where it cannot be run in this process or gave nothing.
MINERU_COMMAND = ["mineru", "-p", "{source}", "-o", "{target}", "-m", "auto", "-b", "pipeline"]


class DoclingEngine:
    """Docling: one converter for each worker and set of options."""

    converters: dict[tuple, object] = {}

    def __init__(self, table_mode: str = "fast", do_ocr: bool = True, do_table_structure: bool = True, artifacts_path: str | None = None):
        self.options = (table_mode, do_ocr, do_table_structure, artifacts_path)

    def converter(self):
        if self.options not in self.converters:
            from docling.datamodel.base_models import InputFormat
            from docling.datamodel.pipeline_options import PdfPipelineOptions, TableFormerMode
            from docling.document_converter import DocumentConverter, PdfFormatOption

            table_mode, do_ocr, do_table_structure, artifacts_path = self.options
            made = PdfPipelineOptions()
            made.do_ocr, made.do_table_structure = do_ocr, do_table_structure
            made.table_structure_options.mode = TableFormerMode.FAST if table_mode == "fast" else TableFormerMode.ACCURATE
            made.generate_picture_images, made.images_scale = True, 2.0
            if artifacts_path is not None:
                made.artifacts_path = artifacts_path
            self.converters[self.options] = DocumentConverter(format_options={InputFormat.PDF: PdfFormatOption(pipeline_options=made)})
        return self.converters[self.options]

    def run(self, files):
        from docling.datamodel.base_models import DocumentStream
        from io import BytesIO

        converter = self.converter()
        return {k: json.dumps(converter.convert(DocumentStream(name=n, stream=BytesIO(b))).document.export_to_dict()) for k, (n, b) in files.items()}


def has_content(text: str | None) -> bool:
    return (text or "").strip() not in ("", "[]", "{}", "null")


class Cascade:
    """The first engine that gives a content for a file; if none does, the last error.

    Engines after the first get the files one by one, so that a file that fails costs no other.
    """

    def __init__(self, *engines: Engine):
        self.engines = engines

    def run(self, files):
        out, error = {}, None
        for n, engine in enumerate(self.engines):
            left = {k: v for k, v in files.items() if not has_content(out.get(k))}
            for part in ([left] if not n else [{k: v} for k, v in left.items()]) if left else ():
                try:
                    out |= engine.run(part)
                except Exception as e:  # noqa: BLE001
                    error = e
        if error and not any(map(has_content, out.values())):
            raise RuntimeError(str(error)) from error
        return out


def run_engine(files: DataFrame, factory: Callable[[], Engine], size: int | None = None, keep: tuple[str, ...] = (), layers: bool = False) -> DataFrame:
    """(doc_key, content, error) for ``files`` (doc_key, path, content), in passes of ``size`` files.

    A pass that fails is tried again file by file, so that one bad file costs no other.  Files stay in their partitions;
    on one machine at most ``max_in_flight`` passes run at once.  The columns ``keep`` of a file go along with what is made of
    it, so that nothing has to be joined to it; with ``layers`` so does ``layer``, what ``page_words`` tells of a PDF.  A file
    without content is told with its own ``error``, if there is such a column, and goes through no engine.
    """
    size, most = size or batch_size(), max_in_flight()
    own_error = ["error"] if "error" in files.columns else []
    names = ["doc_key", "path", "content", *own_error, *keep]
    fields = [StructField(c, StringType()) for c in ("doc_key", "content", "error")] + [files.schema[c] for c in keep]
    schema = StructType(fields + ([StructField("layer", ArrayType(LongType()))] if layers else []))

    def run(batches):
        import pyarrow as pa

        engine, group, made, held = factory(), [], [], 0

        def one_pass(group):
            asked = {f"{i}_{Path(p).stem}": (Path(p).name, b) for i, (_, p, b, *_) in enumerate(group)}
            with in_flight(most):
                found = engine.run(asked)
            return [(found.get(name), None) for name in asked]

        def results(group):
            try:
                return one_pass(group)
            except Exception as error:  # noqa: BLE001
                if len(group) == 1:
                    return [(None, str(error))]
                return [r for item in group for r in results([item])]

        def rows(group):
            for (key, path, content, *more), (text, error) in zip(group, results(group)):
                yield (key, text, error, *more[len(own_error) :], *([page_words(content) if path.lower().endswith(".pdf") else None] if layers else []))

        def told(made):
            arrays = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            columns = [batch.column(c) for c in names]
            kinds = [pa.string()] * 3 + [batch.column(c).type for c in keep] + ([pa.list_(pa.int64())] if layers else [])
            for i in range(batch.num_rows):  # one by one, as all contents of a batch would be there twice
                row = [c[i].as_py() for c in columns]
                if row[2] is None:
                    made.append((row[0], None, *(row[3:4] if own_error else [None]), *row[3 + len(own_error) :], *([None] if layers else [])))
                    continue
                group.append(row)
                if len(group) == size:
                    found, group = list(rows(group)), []
                    made, held = made + found, held + sum(len(r[1] or "") for r in found)
                    if held >= TOLD_BYTES:
                        yield told(made)
                        made, held = [], 0
        if group:
            made += rows(group)
        if made:
            yield told(made)

    return files.select(*names).mapInArrow(run, schema)


def page_words(content: bytes) -> list[int] | None:
    """The words of each page's text layer of a PDF; 0 for a page that fails, None for a file that does or is no PDF.

    PDF readers look for a file's mark in its first 1024 bytes; a file without it is not opened.
    """
    if b"%PDF" not in content[:2048]:
        return None
    try:
        import pypdfium2

        pdf = pypdfium2.PdfDocument(content)
        pages = len(pdf)
    except Exception:  # noqa: BLE001  no reader here, or no PDF: the layer is not known
        return None

    def words(i):
        try:
            return len(pdf[i].get_textpage().get_text_range().split())
        except Exception:  # noqa: BLE001
            return 0

    return [words(i) for i in range(pages)]


def text_layer_tokens(files: DataFrame) -> DataFrame:
    """(doc_key, page_idx, n_tokens) of the text layers of ``files`` (doc_key, content), as ``page_words`` tells them."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            told = zip(batch.column("doc_key").to_pylist(), (page_words(c.as_py()) for c in batch.column("content")))
            rows = [(key, i, n) for key, words in told for i, n in enumerate(words or ())]
            k, p, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(p, pa.int32()), pa.array(n, pa.int64())], ["doc_key", "page_idx", "n_tokens"])

    return files.where("content is not null").select("doc_key", "content").mapInArrow(count, "doc_key string, page_idx int, n_tokens long")


def _settings(dpi: int, max_pixels: int) -> tuple[int, int]:
    """The resolution and the budget of pixels, from the environment where it names them."""
    try:
        return int(os.environ.get("PARSER_RENDER_DPI", dpi)), int(float(os.environ.get("PARSER_MAX_RENDER_MP", max_pixels / 1e6)) * 1e6)
    except ValueError:
        return dpi, max_pixels


def crop_box(box, height: float, scale: float, size: tuple[int, int]) -> tuple[int, int, int, int]:
    """Pixels (left, top, right, bottom) of a box in points with its origin at the bottom left, cut to the image.

    A box without any area in the image is an error.
    """
    x0, y0, x1, y1 = (float(v) for v in box)
    across, down = (lambda v: min(max(v * scale, 0.0), size[0])), (lambda v: min(max((height - v) * scale, 0.0), size[1]))
    left, top, right, bottom = across(x0), down(y1), across(x1), down(y0)
    if right <= left or bottom <= top:
        raise ValueError("the box has no area in the image")
    return int(left), int(top), int(right), int(bottom)


def _png(pdf, page_idx: int, box, dpi: int, max_pixels: int) -> bytes | None:
    """A page, or the part of it in ``box``; null where that fails."""
    import io

    try:
        page = pdf[page_idx]
        scale, (w, h) = dpi / 72, page.get_size()
        if w * h * scale * scale > max_pixels > 0:
            scale *= (max_pixels / (w * h * scale * scale)) ** 0.5
        image = page.render(scale=scale).to_pil()
        if box is not None:
            image = image.crop(crop_box(box, h, scale, image.size))
        out = io.BytesIO()
        image.save(out, "PNG")
        return out.getvalue()
    except Exception:  # noqa: BLE001
        return None


def _opened(content):
    try:
        import pypdfium2

        return pypdfium2.PdfDocument(content)
    except Exception:  # noqa: BLE001  no reader here, or no PDF
        return None


def page_rasters(pages: DataFrame, dpi: int = 144, max_pixels: int = 40_000_000) -> DataFrame:
    """``pages`` (doc_key, page_idx, content) as PNG, whole or (with ``bbox``) cut to a region; null where that fails."""
    boxed = "bbox" in pages.columns
    slim = pages.select("doc_key", "page_idx", "content", *(["bbox"] if boxed else []))
    dpi, max_pixels = _settings(dpi, max_pixels)

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            drawn = [_png(_opened(r["content"]), r["page_idx"], r.get("bbox"), dpi, max_pixels) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.binary())], ["doc_key", "page_idx", "png"])

    return slim.mapInArrow(draw, "doc_key string, page_idx int, png binary")


def region_rasters(files: DataFrame, regions: DataFrame, dpi: int = 144, max_pixels: int = 40_000_000) -> DataFrame:
    """(doc_key, block_pos, picture): the ``regions`` (doc_key, block_pos, page_idx, bbox) of ``files`` (doc_key, content) as PNG.

    A file is sent and opened once for all its regions; what cannot be drawn gives no row.
    """
    asked = regions.groupBy("doc_key").agg(F.collect_list(F.struct("block_pos", "page_idx", "bbox")).alias("asked"))
    dpi, max_pixels = _settings(dpi, max_pixels)

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                pdf = _opened(row["content"])
                drawn = [(r["block_pos"], _png(pdf, r["page_idx"], r["bbox"], dpi, max_pixels)) for r in row["asked"]] if pdf else []
                kept = [d for d in drawn if d[1] is not None]
                at, png = zip(*kept) if kept else ((), ())
                names = ["doc_key", "block_pos", "picture"]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_key"]] * len(kept), pa.string()), pa.array(at, pa.int32()), pa.array(png, pa.binary())], names)

    return files.join(asked, "doc_key").select("doc_key", "content", "asked").mapInArrow(draw, "doc_key string, block_pos int, picture binary")
