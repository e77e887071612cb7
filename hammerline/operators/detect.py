"""Where a detector is plugged in: images in, boxes and errors out, both of checked form.

The detector itself is the user's.  It is made once in each task and given a few
images at a time, by their content or their URLs; what it returns becomes rows
that `severity` takes, and what fails becomes rows of the error table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.functions import text as X
from hammerline.sources.fix import fixed
from hammerline.sources.tables import require_columns


class Image(NamedTuple):
    """What a detector gets: the file's bytes (null where the table has none) and its URL."""

    url: str | None
    content: bytes | None


class Found(NamedTuple):
    """What a detector gives for an image: its size and its boxes (class, conf, x1, y1, x2, y2) in pixels."""

    width: int
    height: int
    boxes: Iterable[Sequence[Any]]


#: A detector: for some images as many results, each a Found or the exception that kept it from being one.
Detector = Callable[[list[Image]], Sequence[Found | Exception]]

DETECTIONS = "vin string, channel string, view_no int, img_w int, img_h int, box_id long, class string, conf double, x1 double, y1 double, x2 double, y2 double"
_FIELDS = [("vin", pa.string()), ("channel", pa.string()), ("view_no", pa.int32()), ("img_w", pa.int32()), ("img_h", pa.int32()), ("box_id", pa.int64()), ("class", pa.string()), *[(c, pa.float64()) for c in ("conf", "x1", "y1", "x2", "y2")]]
_ERROR = [("stage", pa.string()), ("error", pa.string()), ("url", pa.string())]


def _checked(found: Found) -> list[tuple]:
    """The boxes with their ids; a ValueError where they are not of the form agreed on."""
    width, height, boxes = found
    if not (int(width) > 0 and int(height) > 0):
        raise ValueError("an image without size")
    out = []
    for k, (name, *numbers) in enumerate(boxes):
        conf, x1, y1, x2, y2 = map(float, numbers)
        if not isinstance(name, str) or not name:
            raise ValueError("a box without a class")
        if not all(map(math.isfinite, (conf, x1, y1, x2, y2))) or not 0 <= conf <= 1 or x2 < x1 or y2 < y1:
            raise ValueError(f"a box of {name} out of range")
        out.append((int(width), int(height), k, name, conf, x1, y1, x2, y2))
    return out


def detections(images: DataFrame, make: Callable[[], Detector], at_once: int = 8) -> tuple[DataFrame, DataFrame]:
    """(detections, errors) of a table vin, channel, view_no, url and, if it has one, content.

    `make` gives a task its detector.  An image that the detector gives an
    exception for is an error of stage `detect`, one with malformed boxes of stage
    `contract`; the others of its lot are not lost.  An exception that the
    detector raises itself counts for each image of the lot.  A wrong number of
    results is a fault of the detector and ends the job.  The detector runs once
    for each image: its rows are written to the shared folder and read twice.
    """
    rows = require_columns(images, ["vin", "channel", "view_no", "url"])
    content = F.col("content").cast("binary") if "content" in images.columns else F.lit(None).cast("binary")
    rows = rows.select(F.col("vin").cast("string").alias("vin"), F.col("channel").cast("string").alias("channel"), F.col("view_no").cast("int").alias("view_no"), F.col("url").cast("string").alias("url"), content.alias("content"))

    def run(batches):
        detector = make()
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                lot = batch.slice(start, at_once).to_pylist()
                try:
                    found = list(detector([Image(r["url"], r["content"]) for r in lot]))
                except Exception as e:  # noqa: BLE001  whatever it is, it is reported
                    found = [e] * len(lot)
                if len(found) != len(lot):
                    raise RuntimeError(f"a detector gave {len(found)} results for {len(lot)} images")
                out = []
                for r, x in zip(lot, found, strict=True):
                    view = r["vin"], r["channel"], r["view_no"]
                    try:
                        if isinstance(x, Exception):
                            out.append((*view, *[None] * 9, "detect", f"{type(x).__name__}: {x}", r["url"]))
                        else:
                            out += [(*view, *box, None, None, None) for box in _checked(x)]
                    except (TypeError, ValueError) as e:
                        out.append((*view, *[None] * 9, "contract", str(e), r["url"]))
                columns = list(zip(*out, strict=True)) or [()] * (len(_FIELDS) + len(_ERROR))
                fields = [*_FIELDS, *_ERROR]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    made = fixed(rows.mapInArrow(run, f"{DETECTIONS}, stage string, error string, url string"))
    good = made.where("stage IS NULL").drop("stage", "error", "url")
    bad = made.where("stage IS NOT NULL").select("vin", "stage", X.error_text(F.col("error")).alias("error"), "url")
    return good, bad
