"""YAML and TOML text as JSON text, batch-wise in Arrow.

Spark has no YAML or TOML reader.  Only routed files reach these functions (callers pass
NULL otherwise); everything after the text-to-JSON step is built-in Spark.
"""

from __future__ import annotations

import datetime
import json
import math
import re
import tomllib

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])

# Values that a document may have, aliases expanded: so many, and so many more for each character of its text.
EXPANDED, EXPANDED_BY = 100_000, 10

_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class _ConfigLoader(_Loader):
    """YAML 1.2 scalars, string keys, duplicate keys refused, unknown tags read as plain values."""

    yaml_implicit_resolvers: dict = {}


_MAP, _SEQ, _STR = "tag:yaml.org,2002:map", "tag:yaml.org,2002:seq", "tag:yaml.org,2002:str"

for _tag, _pattern, _first in [
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^[-+]?(?:0b[01_]+|0o?[0-7_]+|0x[0-9a-fA-F_]+|[1-9][0-9_]*|0)$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9][0-9_]*(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+0123456789."),
    ("float", r"^(?:[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+."),
    ("timestamp", r"^\d{4}-\d\d?-\d\d?(?:(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?)?)?$", "0123456789"),
    ("merge", r"^<<$", "<"),
]:
    _ConfigLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


def _scalar(loader, node):
    return node.value


def _int(loader, node):
    text = node.value.replace("_", "")
    return int(re.sub(r"^([-+]?)0(?=[0-7])", r"\g<1>0o", text), 0)


def _mapping(loader, node):
    own = [k.value for k, _ in node.value if k.tag != "tag:yaml.org,2002:merge"]
    if len(own) != len(set(map(str, own))):
        raise yaml.YAMLError("mapping key already defined")
    loader.flatten_mapping(node)
    out = {}
    for key, value in node.value:
        if not isinstance(key, yaml.ScalarNode):
            raise yaml.YAMLError("mapping key is not a scalar")
        out[key.value] = loader.construct_object(value, deep=True)
    return out


def _other(loader, suffix, node):
    if isinstance(node, yaml.MappingNode):
        return _mapping(loader, node)
    if isinstance(node, yaml.SequenceNode):
        return loader.construct_sequence(node, deep=True)
    return node.value


_ConfigLoader.add_constructor(_STR, _scalar)
_ConfigLoader.add_constructor("tag:yaml.org,2002:int", _int)
_ConfigLoader.add_constructor(_MAP, _mapping)
_ConfigLoader.add_multi_constructor("!", _other)


def _plain(value, left):
    """JSON has no dates or non-finite numbers: dates in RFC 3339, the others as text.

    ``left`` counts the values that a document may still have: aliases of aliases make a short text expand without end.
    """
    if next(left, None) is None:
        raise yaml.YAMLError("aliases expand too far")
    if isinstance(value, dict):
        return {k: _plain(v, left) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v, left) for v in value]
    if isinstance(value, datetime.datetime):
        text = value.isoformat()
        return text.replace("+00:00", "Z") if value.tzinfo else text + "Z"
    if isinstance(value, datetime.date):
        return f"{value.isoformat()}T00:00:00Z"
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value


def _json(value, most: int) -> str:
    return json.dumps(_plain(value, iter(range(most))), ensure_ascii=False, separators=(",", ":"), default=str)


def _load_yaml(text: str) -> str:
    loader = _ConfigLoader(text)
    try:
        return _json(loader.get_data() if loader.check_data() else None, EXPANDED + EXPANDED_BY * len(text))
    finally:
        loader.dispose()


def _load_toml(text: str) -> str:
    # dates are not strings here: wrapped so that no later step mistakes them for text
    wrap = lambda v: {"date": v.isoformat()} if hasattr(v, "isoformat") else str(v)
    return json.dumps(tomllib.loads(text.replace("\r\n", "\n")), ensure_ascii=False, default=wrap)


_LOADERS = {"yaml": _load_yaml, "toml": _load_toml}


@F.pandas_udf(DOCUMENT)
def _documents(texts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    rows = []
    for text, kind in zip(texts, kinds, strict=True):
        if text is None or kind is None:
            rows.append((None, None))
            continue
        try:
            rows.append((_LOADERS[kind](text), None))
        except Exception as failure:  # a malformed file is data, not a job failure
            rows.append((None, str(failure) or type(failure).__name__))
    return pd.DataFrame(rows, columns=["json", "error"])


def config_document(text: Column, kind: Column) -> Column:
    """struct(json, error) of a text of the kind ``yaml`` (its first document) or ``toml``; NULL members without a kind."""
    return _documents(F.when(kind.isNotNull(), text), kind)
