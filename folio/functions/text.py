"""Column expressions over texts, paths and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures of media types, in the order in which they are tried.
SIGNATURES = (
    ("89504E470D0A1A0A", "image/png"),
    ("255044462D", "application/pdf"),
    ("FFD8FF", "image/jpeg"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
)
ACCEPTED = ("application/pdf", "image/jpeg", "image/png")
MAX_BYTES = 50 * 1024 * 1024

#: Fixed value: what counts as white space, as a class of code points.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def media_type(content: Column) -> Column:
    """The media type that the first bytes show, or null; a declared type is never read."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for signature, kind in reversed(SIGNATURES):
        out = F.when(F.startswith(head, F.lit(signature)), F.lit(kind)).otherwise(out)
    return out


def refusal(kind: Column, size: Column, limit: int = MAX_BYTES) -> Column:
    """Why a source is refused, or null."""
    return F.when(kind.isNull(), "unrecognized").when(~kind.isin(*ACCEPTED), "mime_type").when(size > limit, "size_limit")


def content_id(data: Column) -> Column:
    """"sha256:" and the hash of the bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def canonical(**parts: Column) -> Column:
    """Canonical JSON of string parts: keys sorted, no spaces, nulls kept."""
    return F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"})


def meaningful_length(text: Column) -> Column:
    """Characters that are neither white space nor U+FFFD nor of a control category."""
    return F.length(F.regexp_replace(text, rf"[\p{{C}}{SPACE}\x{{FFFD}}]", ""))


def literal(needle: Column) -> Column:
    """A pattern that matches the needle itself."""
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def find_starts(text: Column, needle: Column) -> Column:
    """Where the needle stands, left to right without overlap; code points from 0. The needle must not be empty."""
    gaps = F.transform(F.split(text, literal(needle)), F.length)
    size = F.length(needle)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    add = lambda s, gap: F.struct((s["at"] + gap + size).alias("at"), F.concat(s["all"], F.array(s["at"] + gap)).alias("all"))
    # The last piece is followed by no needle.
    return F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), start, add, lambda s: s["all"])


def strip_indices(path: Column) -> Column:
    """A declared path: entry indices removed."""
    return F.regexp_replace(path, r"\[[^\]]*\]", "")


def slot(path: Column) -> Column:
    """The slot of an entry's field (indices erased), or null for a plain field."""
    return F.when(path.rlike(r"\[\d+\]"), F.regexp_replace(path, r"\[\d+\]", "[]"))


def path_key(path: Column) -> Column:
    """A sort key of a path: index steps before names, and by number."""
    steps = F.regexp_extract_all(path, F.lit(r"[^.\[\]]+"), F.lit(0))
    digits = lambda s: s.rlike(r"\A\d+\z")
    return F.transform(steps, lambda s: F.struct(F.when(digits(s), 0).otherwise(1).alias("kind"), F.when(digits(s), s.cast("long")).otherwise(0).alias("index"), F.when(digits(s), "").otherwise(s).alias("name")))


def estimated_tokens(text: Column) -> Column:
    """The input budget's estimate of a text's tokens."""
    return F.floor(F.length(text) / F.lit(1.20) * F.lit(1.15)).cast("int") + 1


def quarter_turn(angle: Column) -> Column:
    """The angle by which a viewer turns a page back; other than quarter turns count as none."""
    return F.when(angle.isin(0, 90, 180, 270), F.pmod(360 - angle, F.lit(360))).otherwise(0)


def displayed_box(box: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A box (x0, y0, x1, y1; origin below left) on the page as shown, its origin above left. Width and height are unrotated."""
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    shown = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    return (
        F.when(rotation == 0, shown(x0, height - y1, x1, height - y0))
        .when(rotation == 90, shown(y0, x0, y1, x1))
        .when(rotation == 180, shown(width - x1, y0, width - x0, y1))
        .when(rotation == 270, shown(height - y1, width - x1, height - y0, width - x0))
    )


def beyond(share: Column, tolerance: float = 0.01) -> Column:
    """Whether a share of the page lies further outside than `tolerance`."""
    return (share < -tolerance - 1e-9) | (share > 1 + tolerance + 1e-9)


def normalized(x: Column, size: Column, tolerance: float = 0.01) -> Column:
    """A coordinate as a share of the page; up to `tolerance` beyond an edge counts as the edge, more is null."""
    share = x / size
    return F.when(~beyond(share, tolerance), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
