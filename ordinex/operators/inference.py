"""The place for a model: an adapter, run over batches of probes on the executors.

A model is a class of one's own with :meth:`Adapter.predict`; it is made once for each task
(``make``), so weights are loaded there. Probes that are applied here work on arrays of bytes
(height, width, channels); encoded images need a decoder, JPEG probes a codec, both given by the caller.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Found = tuple[Sequence[float], float, str]
#: The threshold where no configuration names one, and the models that take a second one.
DEFAULT_THRESHOLD, TEXT_THRESHOLD_MODELS = 0.05, ("groundingdino",)
CANDIDATES = "array<struct<box:array<double>,score:double,label:string>>"


class Adapter(ABC):
    """A model: boxes with scores and labels for an image and a query."""

    @abstractmethod
    def predict(self, image: np.ndarray, query: str, top_k: int) -> list[Found]:
        raise NotImplementedError

    def predict_batch(self, images: list[np.ndarray], query: str, top_k: int) -> list[list[Found]]:
        return [self.predict(x, query, top_k) for x in images]


def thresholds(model: str, config: dict) -> dict[str, float]:
    """A model's own thresholds, or the shared ones, or the default."""
    own = config.get("inference_thresholds", {}).get(model, {})
    names = ["box_threshold"] + ["text_threshold"] * (model in TEXT_THRESHOLD_MODELS)
    return {n: float(own.get(n, config.get(n, DEFAULT_THRESHOLD))) for n in names}


def _kernel(sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    x = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return x / x.sum()


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    reach = len(kernel) // 2
    padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
    return sum(w * np.take(padded, np.arange(k, k + image.shape[axis]), axis=axis) for k, w in enumerate(kernel))


def _resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    for axis, size in ((0, height), (1, width)):
        n = image.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
        image = np.take(image, low, axis=axis) * (1 - share) + np.take(image, np.minimum(low + 1, n - 1), axis=axis) * share
    return image


def perturbed(image: np.ndarray, family: str, severity: float, seed: int, codec: Callable[[np.ndarray, int], np.ndarray] | None = None) -> np.ndarray:
    """The image under a probe, of the same size. ``codec`` writes and reads a JPEG at a quality. An unknown family is an error."""
    x = image.astype(float)
    if family == "blur":
        x = _along(_along(x, _kernel(severity), 0), _kernel(severity), 1) if severity > 0 else x
    elif family == "brightness":
        x = x * severity
    elif family == "resolution":
        height, width = image.shape[:2]
        x = _resized(_resized(x, max(1, round(height * severity)), max(1, round(width * severity))), height, width)
    elif family == "gaussian_noise":
        x = x + np.random.default_rng(seed).normal(0, severity * 255, image.shape)
    elif family == "jpeg":
        if codec is None:
            raise ValueError("a JPEG probe needs a codec")
        x = codec(image, int(round(severity))).astype(float)
    else:
        raise ValueError(f"unknown family {family}")
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def infer(tasks: DataFrame, keys: list[str], make: Callable[[], Adapter], decode: Callable[[bytes], np.ndarray], top_k: int = 20, batch_size: int = 8, codec: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """``keys`` and ``candidates`` of each task: ``image`` (bytes), ``query`` and, for a probe, ``family, severity, seed`` (null: the image as it
    is). Tasks of one query that follow one another go to the model together, ``batch_size`` at most; an answer of another length is an error."""
    kinds = {f.name: f.dataType.simpleString() for f in tasks.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = make()
        for f in frames:
            found: list[list[dict]] = []
            new = (f["query"] != f["query"].shift()).cumsum()
            for _, same in f.groupby(new, sort=False):
                for at in range(0, len(same), batch_size):
                    chunk = same.iloc[at : at + batch_size]
                    images = []
                    for r in chunk.itertuples(index=False):
                        image = decode(r.image)
                        images.append(image if pd.isna(r.family) else perturbed(image, r.family, r.severity, int(r.seed), codec))
                    answers = adapter.predict_batch(images, chunk["query"].iloc[0], top_k)
                    if len(answers) != len(chunk):
                        raise RuntimeError(f"the adapter answered {len(answers)} of {len(chunk)} images")
                    found += [[{"box": [float(v) for v in box], "score": float(score), "label": label} for box, score, label in x[:top_k]] for x in answers]
            yield f[keys].assign(candidates=found)

    return tasks.select(*keys, "image", "query", "family", "severity", "seed").mapInPandas(run, f"{', '.join(f'`{k}` {kinds[k]}' for k in keys)}, candidates {CANDIDATES}")
