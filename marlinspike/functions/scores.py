"""Scores, states, times, payloads and the small arithmetic of the screens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def final_score(vector: Column, text: Column) -> Column:
    return 0.75 * vector + 0.25 * text


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def rounded(value: Column, places: int) -> Column:
    """Half-even rounding, as the result files have it."""
    return F.bround(value.cast("double"), places)


def query_status(total: Column, labeled: Column) -> Column:
    return F.when(total == 0, "no_candidates").when(labeled == 0, "unlabeled").when(labeled < total, "partial").otherwise("completed")


def progress_percent(processed: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), processed * 100.0 / total)).otherwise(0.0)


def eta_minutes(processed: Column, total: Column, elapsed_seconds: Column) -> Column:
    """Whole minutes left at the rate so far; null where no rate is known."""
    return F.when((processed > 0) & (elapsed_seconds > 0), F.floor((total - processed) * elapsed_seconds / processed / 60).cast("int"))


def eta_text(processed: Column, total: Column, elapsed_seconds: Column) -> Column:
    left = eta_minutes(processed, total, elapsed_seconds)
    return F.when(left.isNull(), "—").when(left < 1, "即将完成").otherwise(F.concat(F.lit("剩 "), left.cast("string"), F.lit(" 分")))


def clamp(value: Column, least: int, most: int, default: int) -> Column:
    """Whole part of a number or text within bounds; what is neither gives the default."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.expr("int(null)"), value.try_cast("double").cast("int"), F.lit(default))))


def load_color(percent: Column, warn: float, alarm: float) -> Column:
    """green below ``warn``, yellow below ``alarm``, else red (CPU 70/90, memory 80/95)."""
    return F.when(percent < warn, "green").when(percent < alarm, "yellow").otherwise("red")


def luminance(color: Column) -> Column:
    """Relative luminance of #rrggbb."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def grid_move(index: Column, direction: Column, columns: int, count: int) -> Column:
    """Index after one step in a row-wise grid; it stops at edges and in a ragged last row."""
    to = F.when((direction == "left") & (index % columns > 0), index - 1).when((direction == "right") & (index % columns < columns - 1), index + 1)
    to = to.when(direction == "up", index - columns).when(direction == "down", index + columns)
    return F.when(to.between(0, count - 1), to).otherwise(index)


def grid_rows(count: Column, columns: int) -> Column:
    return F.ceil(count / columns)


def grid_targets(place: Column, columns: int, count: Column) -> Column:
    """Struct with the targets (left, right, up, down) of a place of a grid."""
    if columns < 1:
        raise ValueError("a grid has one column at least")
    return F.struct(*[grid_move(place, F.lit(d), columns, count).cast("int").alias(d) for d in ("left", "right", "up", "down")])


def batch_time(elapsed_ms: Column, queries: Column) -> Column:
    """Mean time of a query in a batch; null for an empty one."""
    return F.when(queries > 0, elapsed_ms / queries)


def position_text(position: Column) -> Column:
    """Place in the queue as the screens show it."""
    return F.when(position == 0, "next").when(position > 0, F.concat(position.cast("string"), F.lit(" ahead")))


def parse_time(value: Column) -> Column:
    """UTC timestamp of any of the stored text forms; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


def fresh(heartbeat: Column, now: Column, seconds: int = 90) -> Column:
    """Whether a heartbeat is younger than ``seconds``; null is not."""
    return F.coalesce(heartbeat > now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd_HHmmss")


def payload_paths(kind: Column, payload: Column) -> Column:
    """Query paths of a task payload: a JSON list for batch search, an object for an interactive one, else none."""
    listed = F.filter(F.from_json(payload, "array<string>"), lambda x: x.isNotNull())
    single = F.array(F.get_json_object(payload, "$.query_image_path"))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(kind == "batch_search", listed).when(kind == "interactive_search", F.when(single[0].isNotNull(), single)), none)


def stable_id(*parts: Column) -> Column:
    """A repeatable id in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)
