"""The default engines use every option of the configuration, and MinerU's command where its API fails."""

import json
import sys
from types import ModuleType, SimpleNamespace

import pytest

from docspark import EnrichmentConfig
from docspark.plans.parse import default_engine
from docspark.sources.engines import Cascade, DoclingEngine


@pytest.fixture()
def docling(monkeypatch):
    """Stand-ins for docling's modules; the converters made, by their options."""
    made = []

    class Converter:
        def __init__(self, format_options=None):
            made.append(format_options["pdf"])

        def convert(self, stream):
            return SimpleNamespace(document=SimpleNamespace(export_to_dict=lambda: {"body": stream.name}))

    names = {
        "docling": {}, "docling.datamodel": {},
        "docling.datamodel.base_models": {"InputFormat": SimpleNamespace(PDF="pdf"), "DocumentStream": SimpleNamespace},
        "docling.datamodel.pipeline_options": {
            "PdfPipelineOptions": lambda: SimpleNamespace(table_structure_options=SimpleNamespace(mode=None), artifacts_path=None),
            "TableFormerMode": SimpleNamespace(FAST="FAST", ACCURATE="ACCURATE"),
        },
        "docling.document_converter": {"DocumentConverter": Converter, "PdfFormatOption": lambda pipeline_options: pipeline_options},
    }
    for name, members in names.items():
        module = ModuleType(name)
        module.__dict__.update(members)
        monkeypatch.setitem(sys.modules, name, module)
    monkeypatch.setattr(DoclingEngine, "converters", {})
    return made


def test_docling_is_built_from_the_options(docling):
    config = EnrichmentConfig(parser="docling", do_ocr=False, do_table_structure=False, table_mode="accurate", docling_artifacts_path="/models")
    for _ in range(2):
        assert default_engine(config)().run({"k": ("n.pdf", b"x")}) == {"k": json.dumps({"body": "n.pdf"})}
    default_engine(EnrichmentConfig(parser="docling"))().run({"k": ("n.pdf", b"x")})
    told = [(o.do_ocr, o.do_table_structure, o.table_structure_options.mode, o.artifacts_path) for o in docling]
    assert told == [(False, False, "ACCURATE", "/models"), (True, True, "FAST", None)]


def test_the_mineru_command_is_tried_after_the_api(monkeypatch, tmp_path):
    command = tmp_path / "mineru"
    command.write_text('#!/bin/sh\ncase "$2" in *bad*) exit 1;; esac\nmkdir -p "$4"\necho "[\\"$5 $6 $7 $8\\"]" > "$4/x_content_list.json"\n')
    command.chmod(0o755)
    monkeypatch.setenv("PATH", str(tmp_path), prepend=":")
    got = default_engine(EnrichmentConfig())().run({"a": ("bad.pdf", b"x"), "b": ("b.pdf", b"x")})
    assert {k: json.loads(v) for k, v in got.items()} == {"b": ["-m auto -b pipeline"]}


def test_an_empty_content_goes_to_the_next_engine():
    nothing, some = SimpleNamespace(run=lambda f: {k: "[]" for k in f}), SimpleNamespace(run=lambda f: {k: "[1]" for k in f})
    assert Cascade(nothing, some).run({"a": ("n", b""), "b": ("m", b"")}) == {"a": "[1]", "b": "[1]"}
