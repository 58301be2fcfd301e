"""Schemas from code, and the predicates that enforce them."""

import enum
import json
from typing import Annotated, Dict, List, Literal, Optional

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import schema as s


class Colour(enum.Enum):
    RED = "red"
    BLUE = "blue"


def book(city: str, nights: int, price: float = 1.5, *, pets: bool, extras: List[int], tags: list, more: Dict[str, int], view: Literal["sea", "hill"], paint: Colour, note: Optional[str], other: int | None, bare, stars: Annotated[int, s.Field(ge=1, le=5)], mark: str = s.Field(description="from field", max_length=3), fixed: str = s.Field("x", const=None), **rest):
    """Book a room.

    In a town.

    Args:
        city (str): where to
        mark: from doc
    """


def test_function_schema():
    got = s.function_schema(book)
    p = got["parameters"]["properties"]
    assert got["name"] == "book" and got["description"] == "Book a room. In a town."
    assert {k: p[k]["type"] for k in ("city", "nights", "price", "pets", "extras", "tags", "more", "bare", "other")} == {"city": "string", "nights": "integer", "price": "number", "pets": "boolean", "extras": "array", "tags": "array", "more": "object", "bare": "string", "other": "integer"}
    assert p["city"]["description"] == "where to" and p["mark"] == {"type": "string", "description": "from field", "maxLength": 3}
    assert p["extras"]["items"] == {"type": "integer"} and "items" not in p["tags"]
    assert p["view"] == {"type": "string", "enum": ["sea", "hill"]} and p["paint"]["enum"] == ["red", "blue"]
    assert p["stars"] == {"type": "integer", "minimum": 1, "maximum": 5} and p["fixed"] == {"type": "string", "const": None}
    assert got["parameters"]["required"] == ["city", "nights", "pets", "extras", "tags", "more", "view", "paint", "bare", "stars", "mark"]
    assert "required" not in s.function_schema(lambda: None)["parameters"]


def test_models_and_resolving():
    pydantic = pytest.importorskip("pydantic")

    class Trip(pydantic.BaseModel):
        """A trip."""

        to: str
        days: int = 3

    got = s.model_schema(Trip)
    assert got["name"] == "Trip" and got["description"] == "A trip." and got["parameters"]["required"] == ["to"]
    assert s.json_type(Trip)["type"] == "object"
    tagged = s.tool(lambda a: None)
    schemas, functions = s.resolve([Trip, tagged, {"name": "raw"}, 7])
    assert [x["name"] for x in schemas] == ["Trip", "<lambda>", "raw"] and functions == {"Trip": Trip, "<lambda>": tagged}
    assert s.resolve(json.dumps([{"name": "j"}]))[0] == [{"name": "j"}]


def test_spark_types():
    kind = s.spark_type({"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "number"}}, "c": {"type": "object"}, "d": {}}})
    assert kind == T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(T.DoubleType())), T.StructField("c", T.MapType(T.StringType(), T.StringType())), T.StructField("d", T.StringType())])


def test_every_rule(spark):
    parameters = {
        "properties": {
            "n": {"type": "number", "minimum": 1, "maximum": 9, "exclusiveMinimum": 0, "exclusiveMaximum": 10, "multipleOf": 0.5},
            "t": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "b", "format": "odd", "enum": ["ab", "abc"]},
            "d": {"type": "string", "format": "date"},
            "a": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True},
            "c": {"const": "k"},
        },
        "required": ["n"],
    }
    rows = [(1.5, "ab", "2024-01-01", [1, 2], "k"), (0.0, "a", "1/1/24", [], "x"), (10.25, "abcde", None, [3, 3, 3], "k"), (None, None, None, None, "k")]
    df = spark.createDataFrame(rows, "n double, t string, d string, a array<int>, c string")
    got = [r.v for r in df.select(s.violations({k: F.col(k) for k in df.columns}, parameters).alias("v")).collect()]
    assert got[0] == []
    assert got[1] == sorted(["n.minimum", "n.exclusiveMinimum", "t.minLength", "t.pattern", "t.enum", "d.format", "a.minItems", "c.const"])
    assert got[2] == sorted(["n.maximum", "n.exclusiveMaximum", "n.multipleOf", "t.maxLength", "t.enum", "a.maxItems", "a.uniqueItems"])
    assert got[3] == ["n.required"]
