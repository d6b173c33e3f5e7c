"""Model clients, told apart by a table: what a provider is asked, with which settings, and where its answer is.

There is one client.  It reads a provider's settings from the environment at every call, fills the provider's request in,
hands it to the provider's transport and looks its answer up; whatever fails is an answer with an error.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from docspark.functions.media import SIGNATURES
from docspark.functions.python_only import tolerant_json
from docspark.functions.text import THINKING
from docspark.schema import EnrichmentConfig


def media_type_of(content: bytes) -> str:
    """The media type by the signatures that ``media_type`` knows; image/png if none fits."""
    head = content[:16].hex().upper()
    fits = (kind for kind, marks in SIGNATURES if all(head[2 * at :].startswith(digits) for at, digits in marks))
    return next(fits, "image/png")


def without_thinking(text: str) -> str:
    for span in THINKING:
        text = re.sub(span, "", text)
    return text.strip()


def parsed_answer(text: str) -> dict[str, Any]:
    value = json.loads(tolerant_json(without_thinking(text)))
    return value if isinstance(value, dict) else {"description": ""}


def filled(template: Any, values: dict[str, Any]) -> Any:
    """``template`` with each ``{name}`` in its texts filled in; a text that is one name alone becomes that value."""
    if isinstance(template, dict):
        return {k: filled(v, values) for k, v in template.items()}
    if isinstance(template, list):
        return [filled(v, values) for v in template]
    if not isinstance(template, str):
        return template
    alone = re.fullmatch(r"\{(\w+)\}", template)
    return values[alone[1]] if alone else re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]), template)


def texts_at(body: Any, path: tuple) -> list[str]:
    """The texts at the end of a path: names, places, and conditions {name: value} that keep the members of a list they fit."""
    if not path:
        return [body] if isinstance(body, str) else []
    step, rest = path[0], path[1:]
    if isinstance(step, dict):
        return [t for x in body for t in ([] if any(x.get(k) != v for k, v in step.items()) else texts_at(x, rest))]
    if isinstance(step, int):
        return texts_at(body[step], rest) if len(body) > step else []
    return texts_at(body.get(step), rest)


def _chat(settings: dict[str, str], request: dict[str, Any]) -> Any:
    from openai import OpenAI

    return OpenAI(base_url=settings["url"], api_key=settings["key"]).chat.completions.create(**request).model_dump()


def _invoke(settings: dict[str, str], request: dict[str, Any]) -> Any:
    import boto3

    runtime = boto3.client("bedrock-runtime", region_name=settings["region"])
    return json.loads(runtime.invoke_model(modelId=settings["model"], body=json.dumps(request))["body"].read())


@dataclass(frozen=True)
class Provider:
    settings: dict[str, tuple[str, str]]  # by name: the environment's variable, and what holds without it
    request: dict[str, Any]
    picture: dict[str, Any]  # the part that goes before the prompt where there is a picture
    answer: tuple
    transport: Callable[[dict[str, str], dict[str, Any]], Any]
    words: dict[str, Any] = field(default_factory=lambda: {"type": "text", "text": "{prompt}"})


_MESSAGES = [{"role": "user", "content": "{parts}"}]
# Variables of the environment, and the providers' own names of fields.
PROVIDERS = {
    "openai_compatible": Provider(
        settings={"url": ("OPENAI_BASE_URL", ""), "key": ("OPENAI_API_KEY", "none"), "model": ("VLM_MODEL_NAME", "")},
        request={"model": "{model}", "messages": _MESSAGES, "temperature": 0, "max_tokens": 4096},
        picture={"type": "image_url", "image_url": {"url": "data:{media};base64,{data}"}},
        answer=("choices", 0, "message", "content"),
        transport=_chat,
    ),
    "bedrock": Provider(
        settings={"region": ("AWS_REGION", "ap-southeast-2"), "model": ("BEDROCK_VLM_MODEL", "")},
        request={"anthropic_version": "bedrock-2023-05-31", "max_tokens": 8192, "temperature": 0.0, "messages": _MESSAGES},
        picture={"type": "image", "source": {"type": "base64", "media_type": "{media}", "data": "{data}"}},
        answer=("content", {"type": "text"}, "text"),
        transport=_invoke,
    ),
}


@dataclass(frozen=True)
class Client:
    """A client of one of the PROVIDERS."""

    backend: str

    def settings(self) -> dict[str, str]:
        return {name: os.environ.get(*source) for name, source in PROVIDERS[self.backend].settings.items()}

    def request(self, image: bytes | None, prompt: str, settings: dict[str, str] | None = None) -> dict[str, Any]:
        provider = PROVIDERS[self.backend]
        values = {"prompt": prompt, **(settings or self.settings())}
        if image is not None:
            values |= {"media": media_type_of(image), "data": base64.b64encode(image).decode()}
        parts = [provider.words] if image is None else [provider.picture, provider.words]
        return filled(provider.request, values | {"parts": filled(parts, values)})

    def read(self, body: Any) -> dict[str, Any]:
        return parsed_answer("".join(texts_at(body, PROVIDERS[self.backend].answer)))

    def call(self, image_bytes: bytes | None, prompt: str, mode: str) -> dict[str, Any]:
        try:
            settings = self.settings()
            return self.read(PROVIDERS[self.backend].transport(settings, self.request(image_bytes, prompt, settings)))
        except Exception as error:  # noqa: BLE001
            return {"error": str(error)}


def make_client(config: EnrichmentConfig) -> Client:
    return Client(config.vlm_backend)


def model_name(config: EnrichmentConfig) -> str:
    """The provider and the model that the environment names: what answers are kept under."""
    return f"{config.vlm_backend}:{Client(config.vlm_backend).settings()['model']}"
