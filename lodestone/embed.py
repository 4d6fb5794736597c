"""Embedders: a model when one is configured, and stand-ins.

``HashedEmbedder`` has no notion of meaning: it hashes tokens to components. It
makes everything else testable without a model, and nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import InferenceFailed, ModelLoadFailed, ModelNotFound, TokenizerFailed
from lodestone.functions.text import tokenize


@dataclass(frozen=True)
class EmbeddingConfig:
    model_name: str = "bge-small-en-v1.5"
    dimension: int = 384
    max_length: int = 512
    path: str | None = None


class Embedder:
    name = "none"

    def prepare(self, text: Column) -> Column:
        """What the worker gets of a text."""
        return text

    def vectors(self):
        """A function from an Arrow array of prepared values to unit vectors; called
        once in each worker's task."""
        raise NotImplementedError

    def validate(self) -> None: ...

    def forget(self) -> None:
        """Drop what this process keeps of the model's files."""

    def embed(self, df: DataFrame, text: str, to: str = "embedding") -> DataFrame:
        """``df`` with the column ``to``, through one Arrow stage."""
        names = [c for c in df.columns if c != to]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors = self.vectors()
            for batch in batches:
                made = vectors(batch.column(len(names)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(made), pa.list_(pa.float32()))], names=[*names, to])

        rows = df.select(*names, self.prepare(F.col(text)).alias("__prepared"))
        fields = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
        return rows.mapInArrow(run, f"{fields}, `{to}` array<float>")


@dataclass(frozen=True)
class HashedEmbedder(Embedder):
    dim: int = 64

    @property
    def name(self) -> str:
        return f"hashed-{self.dim}"

    def prepare(self, text: Column) -> Column:
        return tokenize(F.coalesce(text, F.lit("")))

    def vectors(self):
        """Signed counts of hashed tokens; a token is hashed once in a batch."""

        def make(rows: pa.Array) -> np.ndarray:
            found = rows.flatten().dictionary_encode()
            known = [int.from_bytes(md5(t.encode()).digest()[:4], "big") for t in found.dictionary.to_pylist()]
            h = np.array(known, dtype=np.int64)[found.indices.to_numpy()]
            row = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).fill_null(0).to_numpy())
            counts = np.bincount(row * self.dim + np.mod(h >> 1, self.dim), weights=np.where(h & 1, 1.0, -1.0), minlength=len(rows) * self.dim).reshape(-1, self.dim)
            size = np.linalg.norm(counts, axis=1, keepdims=True)
            return (counts / np.where(size > 0, size, 1)).astype(np.float32)

        return make


@dataclass(frozen=True)
class OnnxEmbedder(Embedder):
    """A BERT-like encoder: at most max_length tokens, the first token's hidden
    state, at unit length. The session is opened once per worker process."""

    config: EmbeddingConfig = EmbeddingConfig()

    @property
    def name(self) -> str:
        return self.config.model_name

    def _files(self) -> tuple[Path, Path]:
        if not self.config.path:
            raise ModelNotFound()
        model, tokenizer = Path(self.config.path) / "model.onnx", Path(self.config.path) / "tokenizer.json"
        if not model.exists() or not tokenizer.exists():
            raise ModelNotFound(f"model.onnx and tokenizer.json are not both in {self.config.path}")
        return model, tokenizer

    def validate(self) -> None:
        self._files()

    def vectors(self):
        import onnxruntime
        from tokenizers import Tokenizer

        model, tokenizer = map(str, self._files())
        most = self.config.max_length
        try:
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            session = onnxruntime.InferenceSession(model, options)
        except Exception as e:
            raise ModelLoadFailed(str(e)) from e
        try:
            tokens = Tokenizer.from_file(tokenizer)
        except Exception as e:
            raise TokenizerFailed(str(e)) from e
        wanted = {i.name for i in session.get_inputs()}

        def make(texts: pa.Array) -> list[np.ndarray]:
            out = []
            for text in texts.to_pylist():
                ids = np.array([tokens.encode(text or "").ids[:most]], dtype=np.int64)
                feed = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
                try:
                    hidden = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
                except Exception as x:
                    raise InferenceFailed(str(x)) from x
                out.append(unit(np.asarray(hidden)[0, 0]))
            return out

        return make


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32)
