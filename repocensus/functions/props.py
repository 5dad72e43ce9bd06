"""JSON property bags: building them with sorted keys, and flattening them for storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property keys that would shadow a column of the findings table.
COLUMN_KEYS = ["name", "type", "category", "path", "reponame"]


@dataclass(frozen=True)
class Json:
    """A column that already is JSON text (numbers included)."""

    text: Column


def number(value: Column) -> Json:
    return Json(value.cast("string"))


def props(**values: Column | Json) -> Column:
    """JSON object of the given values, keys sorted, NULL values left out."""
    members = []
    for key in sorted(values):
        value = values[key]
        text = value.text if isinstance(value, Json) else json_text(value)
        members.append(F.concat(F.lit(f'"{key}":'), text))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def json_text(value: Column) -> Column:
    """A string as a JSON string literal; only text that needs escapes pays for them."""
    escaped = F.to_json(F.array(value))
    return F.when(
        value.rlike(r'[\x00-\x1f"\\]'), F.substring(escaped, F.lit(2), F.length(escaped) - 2)
    ).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def json_object(json_values: Column) -> Column:
    """MAP<STRING, STRING> of ready-made JSON values as one object, keys sorted."""
    # entries, not keys: inside a lambda the map would be worked out again for every key
    entries = F.array_sort(F.map_entries(json_values))
    members = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def overlay(base: dict[str, Column], override: Column) -> Column:
    """MAP of JSON values: ``override`` plus those ``base`` entries it does not name."""
    entries = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), v)])
    kept = F.map_filter(entries, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def json_members(obj: Column) -> Column:
    """MAP<STRING, STRING> of a JSON object's members, each value as JSON text.

    Of members with the same key the last one counts.
    """

    def last_of_each(members: Column) -> Column:
        entries = F.map_entries(members)
        last = F.filter(
            entries,
            lambda e, i: ~F.exists(
                F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
            ),
        )
        # Hardly any object repeats a key; only such objects are searched for the last member of each.
        repeats = F.size(F.array_distinct(F.map_keys(members))) < F.size(members)
        once = F.when(repeats, F.map_from_entries(last)).otherwise(members)
        return F.transform_values(once, lambda k, v: F.to_json(v))

    # an array of one, as a lambda's variable is read several times and parsed once
    parsed = F.array(F.from_json(obj, "MAP<STRING, VARIANT>"))
    return F.get(F.transform(parsed, last_of_each), F.lit(0))


# A bag of plain scalars, by far the most common, needs no rewriting.
_FLAT = (
    r'\A\{(?:"[^"\\]*+":(?:"[^"\\\x00-\x1f]*+"|-?\d++(?:\.\d++)?|true|false|null)(?:,(?=")|(?=\})))*+\}\z'
)
_COLUMN_KEY = '(?i)"(?:' + "|".join(COLUMN_KEYS) + ')":'


def is_column_key(key: Column) -> Column:
    return F.lower(key).isin(COLUMN_KEYS)


def flatten(properties: Column) -> Column:
    """Storage form of a property bag.

    Keys named like a column go, nested objects become JSON strings, lists and scalars
    stay, and an absent or unreadable bag is ``{}``.
    """
    members = F.map_filter(json_members(properties), lambda k, v: ~is_column_key(k))
    flat = F.transform_values(
        members, lambda k, v: F.when(v.startswith("{"), json_text(v)).otherwise(v)
    )
    as_is = properties.rlike(_FLAT) & ~properties.rlike(_COLUMN_KEY)
    return F.when(as_is, properties).otherwise(F.coalesce(json_object(flat), F.lit("{}")))
