"""Single-value rules: durations, dates, sprite names, paths, captions, strict replies and label encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compass names of the directions, and short names of the views.
DIRECTION_NAMES = {
    "n": "up", "north": "up", "s": "down", "south": "down", "e": "right", "east": "right", "w": "left", "west": "left",
    "ne": "up_right", "nw": "up_left", "se": "down_right", "sw": "down_left",
}
VIEW_NAMES = {"profile": "side", "3_4": "three_quarter", "threequarters": "three_quarter", "topdown": "top_down", "iso": "isometric"}
# Confidences of a label by the way it was found.
CONFIDENCE = {"missing": 0.0, "exact": 1.0, "alias": 0.98, "embedded_token": 0.85, "unmapped": 0.0}
# Words of a state name that tell its action, in order of priority.
STATE_WORDS = (
    ("death", "dead death die dying"), ("attack", "attack attacking preattack"), ("run", "run running"), ("walk", "walk walking"),
    ("move", "move moving"), ("idle", "idle idling standing waiting"), ("spawn", "spawn spawning"), ("sleep", "sleep sleeping"),
    ("rest", "rest resting"), ("sit", "sit sitting"), ("hurt", "hurt hit crit critical"), ("stun", "stun stunned"),
    ("dance", "dance dancing"), ("jump", "jump jumping"), ("fly", "fly flying"), ("swim", "swim swimming"), ("emote", "emote wiggle roar"),
)
# Marks of a tokenizer that captions may hold, and words that speak of the canvas instead of the subject.
CAPTION_MARKS = ("<pad>", "</s>", "<s>")
CANVAS_WORDS = ("background", "pixelated appearance")


def half_away(value: Column, digits: int = 0) -> Column:
    """Rounding half away from zero; null stays null."""
    return F.round(value, digits)


def literal_milliseconds(text: Column) -> Column:
    """Milliseconds of "120", "120ms" or "3s"; any other literal, and one beyond 18 digits, gives null."""
    found = F.trim(text)
    value = F.regexp_extract(found, r"^([0-9]{1,18})(?:ms|s)?$", 1)
    number = F.when(value != "", value.cast("bigint"))
    return F.when(F.endswith(found, F.lit("s")) & ~F.endswith(found, F.lit("ms")), number * 1000).otherwise(number)


def decisecond_milliseconds(text: Column) -> Column:
    """Milliseconds of a positive number of tenths of a second; null where that isn't a whole number of milliseconds."""
    number = F.when(F.trim(text).rlike(r"^[+-]?([0-9]{1,12}(\.[0-9]{0,12})?|\.[0-9]{1,12})$"), F.trim(text).cast("decimal(24,12)"))
    return F.when((number > 0) & (number * 100 == F.floor(number * 100)), (number * 100).cast("bigint"))


def frame_milliseconds(ticks: Column, per_second: Column) -> Column:
    """Whole milliseconds of so many ticks, half away from zero; null without a positive rate."""
    return F.when(per_second > 0, half_away(ticks * 1000.0 / per_second).cast("bigint"))


def archive_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """ISO time of the six numbers an archive keeps, null where they are no date."""
    made = F.try_make_timestamp_ntz(*[c.cast("int") for c in (year, month, day, hour, minute, second)])
    return F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss")


def sprite_name(filename: Column) -> Column:
    """(family, frames) of a lump name of six or eight characters as a PNG; null where a part of the name isn't valid.

    ``frames`` holds one or two structs (frame, frame_index, rotation,
    mirrored); the second shows the first flipped.
    """
    leaf = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.regexp_extract(leaf, r"^([A-Za-z0-9]{4}(?:[A-Za-z\[\]\\^_][0-8]){1,2})\.[pP][nN][gG]$", 1)

    def frame(at: int, mirrored: bool) -> Column:
        token = F.upper(F.substring(stem, at, 1))
        return F.struct(
            token.alias("frame"), (F.ascii(token) - 65).alias("frame_index"),
            F.substring(stem, at + 1, 1).cast("int").alias("rotation"), F.lit(mirrored).alias("mirrored"),
        )

    frames = F.when(F.length(stem) == 8, F.array(frame(5, False), frame(7, True))).otherwise(F.array(frame(5, False)))
    return F.when(stem != "", F.struct(F.upper(F.substring(stem, 1, 4)).alias("family"), frames.alias("frames")))


def state_action(name: Column) -> Column:
    """The action that a state name's words tell, by the first rule that one of them meets; null where none does."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"([a-z0-9]+)"), F.lit(1))
    found = F.lit(None).cast("string")
    for action, known in reversed(STATE_WORDS):
        meets = F.arrays_overlap(words, F.array(*[F.lit(w) for w in known.split()]))
        if action == "death":
            meets = meets | F.exists(words, lambda w: F.startswith(w, F.lit("dead")))
        found = F.when(meets, action).otherwise(found)
    return found


def sheet_path(path: Column, actions: list[str], planes: tuple[str, ...] = ("fg", "bg", "front", "behind")) -> Column:
    """(kind, category, action, plane, identity) of a path in a sprite repository.

    ``kind`` follows from the first folder and the extension; of a sheet the
    action is the rightmost word of the path that is a known one, and the
    identity what is left without action and plane. Null for no path.
    """
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    first, leaf = F.lower(F.element_at(parts, 1)), F.lower(F.element_at(parts, -1))
    suffix = F.regexp_extract(leaf, r"(\.[a-z0-9]+)$", 1)
    meta = F.startswith(leaf, F.lit("meta_"))
    kind = (
        F.when(leaf == "credits.csv", "credits")
        .when((first == "spritesheets") & (suffix == ".png"), "sheet")
        .when((first == "spritesheets") & (suffix == ""), "sheet_directory")
        .when(first == "spritesheets", "sheet_auxiliary")
        .when((first == "sheet_definitions") & (suffix == ".json"), F.when(meta, "definition_meta").otherwise("sheet_definition"))
        .when((first == "palette_definitions") & (suffix == ".json"), F.when(meta, "palette_meta").otherwise("palette_definition"))
        .when(suffix.isin(".md", ".txt") | F.startswith(leaf, F.lit("readme")) | F.startswith(leaf, F.lit("license")), "documentation")
        .when(suffix.isin(".js", ".ts", ".cjs", ".css", ".scss", ".html"), "source_code")
        .otherwise("other")
    )
    words = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.regexp_replace(w, r"\.[A-Za-z0-9]+$", ""))
    known = F.filter(words, lambda w: w.isin(actions))
    sheet = kind == "sheet"
    action = F.when(sheet & (F.size(known) > 0), F.element_at(known, -1))
    kept = F.filter(words, lambda w: ~w.isin(list(planes)) & ~F.coalesce(w == action, F.lit(False)))
    plane = F.filter(words, lambda w: w.isin(list(planes)))
    return F.when(path.isNotNull(), F.struct(
        kind.alias("kind"), F.when(sheet, F.get(words, F.lit(0))).alias("category"), action.alias("action"),
        F.when(sheet & (F.size(plane) > 0), F.element_at(plane, -1)).alias("plane"),
        F.when(sheet & (F.size(kept) > 0), F.array_join(kept, "/")).alias("identity"),
    ))


def credit_candidates(path: Column, actions: list[str], aliases: dict[str, list[str]], planes: tuple[str, ...] = ("fg", "bg", "front", "behind")) -> Column:
    """Keys under which a credit list may hold a sheet: its own path, then the path without palette with plane before action, per name of the action."""
    words = F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/")
    at = F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), F.lit(-1), lambda s, i: F.when(F.get(words, i).isin(actions), i).otherwise(s))
    action = F.get(words, at)
    before, after = F.slice(words, F.lit(1), F.greatest(at, F.lit(0))), F.slice(words, at + 2, F.size(words))
    stem = F.array_join(F.concat(before, F.filter(after, lambda w: w.isin(list(planes)))), "/")
    names = F.array(action)
    for name, others in aliases.items():
        names = F.when(action == name, F.array(action, *[F.lit(o) for o in others])).otherwise(names)
    more = F.when(at >= 0, F.transform(names, lambda n: F.concat(F.when(stem != "", F.concat(stem, F.lit("/"))).otherwise(F.lit("")), n, F.lit(".png"))))
    return F.array_distinct(F.concat(F.array(path), F.coalesce(more, F.array().cast("array<string>"))))


def sanitized_caption(text: Column) -> Column:
    """A caption without tokenizer marks, blanks collapsed; blank text gives an empty caption."""
    for mark in CAPTION_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def appearance_caption(text: Column) -> Column:
    """The sentences of a caption that don't speak of the canvas, each closed by a stop."""
    kept = F.filter(
        F.transform(F.split(sanitized_caption(text), r"\."), lambda s: F.trim(s)),
        lambda s: (s != "") & ~F.lower(s).rlike("|".join(CANVAS_WORDS)),
    )
    return F.when(text.isNotNull(), F.concat(F.array_join(kept, ". "), F.when(F.size(kept) > 0, ".").otherwise("")))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most ``width`` letters, filled greedily; a longer word stands alone in its line."""
    none = F.array().cast("array<string>")

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        return (
            F.when(F.size(lines) == 0, F.array(word))
            .when(F.length(last) + 1 + F.length(word) > width, F.array_append(lines, word))
            .otherwise(F.array_append(F.slice(lines, F.lit(1), F.size(lines) - 1), F.concat(last, F.lit(" "), word)))
        )

    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.when(text.isNotNull(), F.aggregate(words, none, step))


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it."""
    bare = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"\n?[ \t]*```$", "")
    return F.trim(F.when(F.startswith(bare, F.lit("```")), inner).otherwise(bare))


def strict_choices(text: Column, choices: dict[str, list[str]]) -> Column:
    """A JSON reply that holds exactly the named fields with allowed values, as a map; null for any other reply."""
    # within brackets, so that anything after the object breaks the reply
    held = F.from_json(F.concat(F.lit("["), unfenced(text), F.lit("]")), "array<map<string,string>>")
    held = F.when(F.size(held) == 1, F.get(held, F.lit(0)))
    names = sorted(choices)
    same = F.array_sort(F.map_keys(held)) == F.array(*[F.lit(n) for n in names])
    fits = same
    for name, allowed in choices.items():
        fits = fits & F.coalesce(held[name].isin(allowed), F.lit(False))
    return F.when(F.coalesce(fits, F.lit(False)), held)


def encoded_labels(df: DataFrame, vocabularies: dict[str, list[str]], strict: bool = False) -> DataFrame:
    """``df`` with ``<column>_id``: the place from 0 of each label in its list, null where it isn't in it; ``strict`` raises there."""
    out = df
    for name, words in vocabularies.items():
        ids = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i)]) if words else F.create_map().cast("map<string,int>")
        found = ids[F.col(name)]
        if strict:
            found = F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(F.col(name), F.lit("null")))).cast("int")).otherwise(found)
        out = out.withColumn(f"{name}_id", found)
    return out


def fixed_label(raw: Column, canonical: list[str], aliases: dict[str, str]) -> tuple[Column, Column]:
    """(value, method) of a raw label against a short list: missing, exact, alias, embedded_token (the longest name among its words, of equal ones the first) or unmapped; else unknown."""
    from framewright.functions.labels import slug

    key = slug(raw)
    names = {**aliases, **{c: c for c in canonical}}
    value, method = F.lit("unknown"), F.lit("unmapped")
    padded = F.concat(F.lit("_"), key, F.lit("_"))
    for name in sorted(sorted(names, reverse=True), key=len):
        hit = F.contains(padded, F.lit(f"_{name}_"))
        value, method = F.when(hit, names[name]).otherwise(value), F.when(hit, "embedded_token").otherwise(method)
    for name, target in names.items():
        value = F.when(key == name, target).otherwise(value)
        method = F.when(key == name, "exact" if name in canonical else "alias").otherwise(method)
    absent = F.coalesce(raw, F.lit("")) == ""
    return F.when(absent, "unknown").otherwise(value), F.when(absent, "missing").otherwise(method)


def confidence_of(method: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[method]
