"""Adapters for models that a worker loads once: sentence encoders and text generators.

The engine itself brings stand-ins only. An encoder or generator is given to it as a factory
without arguments, called in each worker task; the factories made here keep the loaded model
for all tasks of a worker process.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np

from spanforge.operators.answer import Request

MAX_TOKENS = 128  # of a text that is encoded
_loaded: dict[Any, Any] = {}
_lock = threading.Lock()


def once(key: Any, load: Callable[[], Any]) -> Any:
    """What ``load`` gives, loaded once per worker process and key."""
    with _lock:
        if key not in _loaded:
            _loaded[key] = load()
        return _loaded[key]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors [text, token, dim] that the mask keeps, as unit vectors; a text
    without tokens is all zero."""
    mask = mask[:, :, None].astype(np.float32)
    mean = (hidden * mask).sum(1) / np.maximum(mask.sum(1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _open_onnx(folder: str, max_tokens: int, threads: int):
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    tokenizer.enable_truncation(max_tokens)
    tokenizer.enable_padding()
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    return tokenizer, onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), options, providers=["CPUExecutionProvider"])


def sentence_encoder(folder: str, max_tokens: int = MAX_TOKENS, threads: int = 1, opened: Callable[[str, int, int], tuple] = _open_onnx) -> Callable[[], Callable]:
    """Factory of a text encoder from a folder with ``tokenizer.json`` and ``model.onnx``, whose
    first output has a vector per token: mean-pooled unit vectors of texts cut to ``max_tokens``.
    The folder is read on the workers, so it must be on a path they share."""

    def factory():
        tokenizer, session = once(("encoder", folder, max_tokens, threads), lambda: opened(folder, max_tokens, threads))
        names = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> np.ndarray:
            found = tokenizer.encode_batch(texts)
            ids, mask = (np.array([getattr(f, a) for f in found], np.int64) for a in ("ids", "attention_mask"))
            feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return pooled(session.run(None, {n: v for n, v in feeds.items() if n in names})[0], mask)

        return encode

    factory.takes_text = True
    return factory


@dataclass(frozen=True)
class Generation:
    """How answers are generated; greedy, without sampling."""

    max_new_tokens: int = 60
    max_prompt_tokens: int = 1024
    repetition_penalty: float = 1.15


@dataclass
class LanguageModel:
    """What a loaded model offers. ``chat`` makes one text of the system and the user part,
    ``generate`` gets prompt ids and the settings and gives the new ids only."""

    chat: Callable[[str, str], str]
    encode: Callable[[str], Sequence[int]]
    decode: Callable[[Sequence[int]], str]
    generate: Callable[[Sequence[int], Generation], Sequence[int]]


def chat_text(system: str, user: str) -> str:
    """The two parts in the ChatML form, with the answer's turn opened and its thinking closed."""
    return f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


def answer_generator(key: str, load: Callable[[], LanguageModel], settings: Generation = Generation()) -> Callable[[], Callable]:
    """Factory of a generator: each request's system part and prompt become one chat, which is
    cut to ``max_prompt_tokens`` before the model answers it. ``load`` runs once per worker."""

    def factory():
        model = once(("generator", key), load)

        def generate(batch: list[Request]) -> list[str]:
            out = []
            for r in batch:
                ids = list(model.encode(model.chat(r.system, r.prompt)))[: settings.max_prompt_tokens]
                out.append(model.decode(model.generate(ids, settings)))
            return out

        return generate

    return factory
