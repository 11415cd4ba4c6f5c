"""Adapters of models, with fake ones in their place."""

import numpy as np
from pyspark.sql import functions as F

from spanforge import models as M
from spanforge.functions.spans import SYSTEM_PROMPT
from spanforge.operators import answer as A
from spanforge.operators import retrieval as R


class Words:
    """One token a word, its length as its id."""

    def __init__(self, most):
        self.most = most

    def encode_batch(self, texts):
        rows = [[len(w) for w in t.split()][: self.most] for t in texts]
        width = max(map(len, rows), default=0)
        one = type("E", (), {})
        out = []
        for r in rows:
            e = one()
            e.ids, e.attention_mask = r + [0] * (width - len(r)), [1] * len(r) + [0] * (width - len(r))
            out.append(e)
        return out


class Session:
    """Each token's vector is its id and 1."""

    def get_inputs(self):
        return [type("I", (), {"name": n})() for n in ("input_ids", "attention_mask")]

    def run(self, _, feeds):
        assert set(feeds) == {"input_ids", "attention_mask"}
        return [np.stack([feeds["input_ids"], np.ones_like(feeds["input_ids"])], axis=2).astype(np.float32)]


def test_encoder_pools_cuts_and_batches(spark):
    M._loaded.clear()
    opened = []
    encode = M.sentence_encoder("somewhere", 2, opened=lambda folder, most, threads: (opened.append(folder), (Words(most), Session()))[1])()
    M.sentence_encoder("somewhere", 2, opened=None)()  # already loaded
    got = encode(["aaa b cccccc", "aa"])
    want = np.array([[2, 1], [2, 1]]) / np.sqrt(5)
    assert opened == ["somewhere"] and np.allclose(got, want) and not encode([""]).any()

    def factory():
        def run(texts):
            assert len(texts) <= 2
            return np.array([[len(t), 0.0] for t in texts], np.float32)

        return run

    factory.takes_text = True
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "x")], "chunk_id long, t string").coalesce(1)
    assert {r.chunk_id: r.embedding for r in R.embed(rows, "chunk_id", F.col("t"), factory, batch_size=2).collect()} == {1: [3, 0], 2: [0, 0], 3: [1, 0]}


def test_generator_gets_the_whole_prompt():
    M._loaded.clear()
    seen = []

    def generate(ids, settings):
        seen.append((list(ids), settings))
        return [ord(c) for c in "Answer: yes"]

    load = lambda: M.LanguageModel(M.chat_text, lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids)), generate)
    run = M.answer_generator("fake", load, M.Generation(max_new_tokens=7, max_prompt_tokens=90))()
    assert run([A.Request("Be short.", "Context:\nc\n\nQuestion: q", "c", "q"), A.Request("s", "x" * 500, "c", "q")]) == ["Answer: yes"] * 2
    text = "".join(map(chr, seen[0][0]))
    assert text.startswith("<|im_start|>system\nBe short.<|im_end|>\n<|im_start|>user\nContext:\nc") and len(text) == 90
    assert len(seen[1][0]) == 90 and seen[0][1] == M.Generation(7, 90, 1.15)


def test_answers_pass_system_and_prompt(spark):
    rows = spark.createDataFrame([(f"q{i}", "why?", "because" if i else "") for i in range(4)], "question_id string, question string, context string").coalesce(1)
    asked = A.prompts(rows.select("question_id", "question"), rows.select("question_id", "context"))

    def factory():
        def run(batch):
            assert len(batch) <= 2 and all(r.system == SYSTEM_PROMPT and r.prompt == f"Context:\n{r.context}\n\nQuestion: {r.question}" for r in batch)
            return [f"{r.context} {r.question}" for r in batch]

        return run

    got = {r.question_id: r.answer for r in A.generate_answers(asked, factory, batch_size=2).collect()}
    assert got == {"q0": A.NO_CONTEXT, "q1": "because why?", "q2": "because why?", "q3": "because why?"}
