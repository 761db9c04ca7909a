"""JSON Schema documents as columns that test JSON texts.

`compile_schema` resolves references and gives a tree of rules; `violations_of` turns it into columns: types of the values
at all paths (`a.b`) first, then one test a path, with only the keywords that its rule has. Both are compiled by Spark; a
walk over entries with lambdas is interpreted and slower. Only items of arrays (`a[]`) go through a
lambda. So the plan grows with the properties of the schema, and the work of a row with those of its kind.

Understood: $ref into $defs, type, const, enum, properties, required, additionalProperties (true or false), items, uniqueItems,
minItems, maxItems, minLength, maxLength, pattern, minimum, maximum, format (date-time, uuid); oneOf of a schema and
null anywhere, and at the root oneOf of objects that a constant property tells apart. Other keywords that would restrict a
value are refused when the schema is compiled, as are references in circles.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ISO, UUID

TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
NOTES = ("$schema", "$id", "$defs", "title", "description", "$comment", "examples", "default")
KNOWN = ("$ref", "oneOf", "type", "const", "enum", "properties", "required", "additionalProperties", "items", "uniqueItems", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "format")
FORMATS = ("date-time", "uuid")
#: A rule: path, prefix of what is below, keywords, and the rules below. Keywords that are not there are None.
Rule = dict


class SchemaError(ValueError):
    pass


class Compiled(NamedTuple):
    """tag: the property that tells the kinds apart, or None; roots: the rule of each kind."""

    tag: str | None
    roots: dict[str, Rule]


def compile_schema(document: dict) -> Compiled:
    root = _resolved(document, document, ())
    alternatives = [_resolved(a, document, ()) for a in root["oneOf"]] if "oneOf" in root else [root]
    tag = None
    if len(alternatives) > 1:
        constants = [{k for k, v in a.get("properties", {}).items() if isinstance(_resolved(v, document, ()).get("const"), str) and k in a.get("required", [])} for a in alternatives]
        for name in sorted(set.intersection(*constants)):
            if len({a["properties"][name]["const"] for a in alternatives}) == len(alternatives):
                tag = name
        if tag is None:
            raise SchemaError("oneOf: no constant property tells the alternatives apart")
    names = [a["properties"][tag]["const"] if tag else "" for a in alternatives]
    return Compiled(tag, {name: _rule("", a, document, ()) for name, a in zip(names, alternatives, strict=True)})


def _resolved(schema: dict, document: dict, seen: tuple[str, ...]) -> dict:
    """Without a reference at its top, and with `null` in place of oneOf a schema and null."""
    if "$ref" in schema:
        name = schema["$ref"]
        if name in seen:
            raise SchemaError("references in a circle")
        target = document
        for part in name.removeprefix("#/").split("/"):
            if not isinstance(target, dict) or part not in target or not name.startswith("#/"):
                raise SchemaError(f"no such definition: {name}")
            target = target[part]
        return _resolved(target, document, (*seen, name))
    if "oneOf" in schema:
        others = [s for s in schema["oneOf"] if s != {"type": "null"}]
        if len(others) == 1 and len(schema["oneOf"]) == 2:
            inner = _resolved(others[0], document, seen)
            return inner | {"nullable": True}
    return schema


def _rule(path: str, schema: dict, document: dict, seen: tuple[str, ...]) -> Rule:
    name = schema.get("$ref")
    if name in seen:
        raise SchemaError("references in a circle")
    seen = (*seen, name) if name else seen
    s = _resolved(schema, document, ())
    unknown = [k for k in s if k not in KNOWN and k not in NOTES and k != "nullable"]
    if unknown or ("oneOf" in s and path) or s.get("format", FORMATS[0]) not in FORMATS or not isinstance(s.get("additionalProperties", True), bool):
        raise SchemaError(f"not understood at {path or 'the root'}: {unknown or 'oneOf, format or additionalProperties'}")
    types = s.get("type")
    types = [types] if isinstance(types, str) else types
    if types and not set(types) <= set(TYPES):
        raise SchemaError(f"no such type at {path or 'the root'}")
    options = [s["const"]] if "const" in s else s.get("enum")
    if s.get("nullable"):
        types = types and [*types, "null"]
        options = options and [*options, None]
    of_text = any(k in s for k in ("minLength", "maxLength"))
    spell = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    prefix = path and f"{path}."
    return {
        "path": path,
        "prefix": prefix,
        "types": types,
        "options": None if options is None else [spell(v) for v in options],
        "low": s.get("minimum"),
        "high": s.get("maximum"),
        "shortest": s.get("minLength") if of_text else s.get("minItems"),
        "longest": s.get("maxLength") if of_text else s.get("maxItems"),
        "pattern": s.get("pattern"),
        "format": s.get("format"),
        "distinct": s.get("uniqueItems", False),
        "closed": s.get("additionalProperties") is False,
        "required": sorted(s.get("required", [])),
        "children": {key: _rule(f"{prefix}{key}", child, document, seen) for key, child in sorted(s.get("properties", {}).items())},
        "items": _rule(f"{path}[]", s["items"], document, seen) if "items" in s else None,
    }


def _get(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


class Stages:
    """Columns that the tests need, each computed once: every stage is a projection that reads those before it."""

    def __init__(self) -> None:
        self.stages: list[dict[str, Column]] = []
        self.names: dict[tuple[str, str], tuple[str, int]] = {}

    def add(self, what: str, path: str, column: Column, after: int) -> tuple[Column, int]:
        """The column and its stage, the one behind `after`. Alternatives share what is at a path."""
        if (what, path) not in self.names:
            self.names[what, path] = name, stage = f"__{len(self.names)}", after + 1
            self.stages += [{} for _ in range(stage + 1 - len(self.stages))]
            self.stages[stage][name] = column
        name, stage = self.names[what, path]
        return F.col(name), stage


class Place:
    """A value of a text, and what the tests ask of it. Keys are looked up in a map of the object, since a variant is slow
    to say that it lacks a path. The tests read no variant, so that values are not copied from stage to stage. Without stages, inside lambdas, all is computed where it stands."""

    def __init__(self, value: Column, path: str, stages: Stages | None, stage: int, kind: Column | None = None) -> None:
        self.value, self.path, self.stages, self.stage = value, path, stages, stage
        self.kind = self.staged("kind", F.schema_of_variant(value))[0] if kind is None else kind

    def staged(self, what: str, column: Column, more: int = 0) -> tuple[Column, int]:
        return self.stages.add(what, self.path, column, self.stage + more) if self.stages else (column, 0)

    def text(self) -> Column:
        return self.staged("text", _get(self.value, "string"))[0]

    def items(self) -> Column:
        return self.staged("items", _get(self.value, "array<variant>"))[0]

    def number(self) -> Column:
        return self.staged("number", F.when(_is(self.kind, "number"), _get(self.value, "double")), 1)[0]

    def spelt(self) -> Column:
        return self.staged("spelt", F.coalesce(F.to_json(self.value), F.lit("null")))[0]

    def keys(self) -> Column:
        fields, stage = self.fields()
        return self.stages.add("keys", self.path, F.map_keys(fields), stage)[0] if self.stages else F.map_keys(fields)

    def fields(self) -> tuple[Column, int]:
        return self.staged("fields", F.when(_is(self.kind, "object"), _get(self.value, "map<string,variant>")), 1)

    def below(self, key: str, path: str, asked: Column | None = None) -> Place:
        fields, stage = self.fields()
        value = F.element_at(fields, key) if asked is None else F.when(asked, F.element_at(fields, key))
        if self.stages:
            value, stage = self.stages.add("value", path, value, stage + 1)
        return Place(value, path, self.stages, stage)


def _is(kind: Column, name: str) -> Column:
    """Whether schema_of_variant says that a value has a type."""
    plain = {"string": "STRING", "null": "VOID", "integer": "BIGINT", "boolean": "BOOLEAN"}
    if name in plain:
        return kind == plain[name]
    if name == "number":
        return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return kind.startswith("ARRAY" if name == "array" else "OBJECT")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _wrong(at: Place, rule: Rule) -> Column | None:
    """Whether a value breaks its rule (null: it is not there). A keyword speaks of values of its own types only."""
    tests, shortest, longest = [], rule["shortest"], rule["longest"]
    if rule["types"] is not None:
        tests.append(~_any([_is(at.kind, t) for t in rule["types"]]))
    if rule["options"] is not None:
        texts, rest = [v for v in map(json.loads, rule["options"]) if isinstance(v, str)], [v for v in rule["options"] if v[0] != '"']
        found = [_is(at.kind, "string") & at.text().isin(texts)] if texts else []
        found += [_is(at.kind, "null")] if "null" in rest else []
        found += [at.spelt().isin(rest)] if set(rest) - {"null"} else []
        tests.append(~_any(found) if found else F.lit(True))
    if rule["low"] is not None or rule["high"] is not None:
        number = at.number()
        tests.append(_is(at.kind, "number") & _any([t for v, t in ((rule["low"], number < rule["low"]), (rule["high"], number > rule["high"])) if v is not None]))
    text_tests, item_tests = [], []
    if (shortest, longest, rule["pattern"], rule["format"]) != (None,) * 4:
        text = at.text()
        size = F.length(text)
        text_tests += [t for v, t in ((shortest, size < shortest), (longest, size > longest)) if v is not None]
        if rule["pattern"] is not None:
            text_tests.append(~F.regexp_like(text, F.lit(rule["pattern"])))
        if rule["format"] == "uuid":
            text_tests.append(~F.lower(text).rlike(UUID))
        if rule["format"] == "date-time":
            text_tests.append(~(text.rlike(ISO + r"(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(text).isNotNull()))
    if (shortest, longest) != (None, None) or rule["distinct"]:
        items = at.items()
        size = F.size(items)
        item_tests += [t for v, t in ((shortest, size < shortest), (longest, size > longest)) if v is not None]
        if rule["distinct"]:
            item_tests.append(F.size(F.array_distinct(F.transform(items, lambda v: F.to_json(v)))) < size)
    for name, found in (("string", text_tests), ("array", item_tests)):
        if found:
            tests.append(_is(at.kind, name) & _any(found))
    return at.kind.isNotNull() & _any(tests) if tests else None


def _codes(at: Place, rule: Rule, asked: dict[str, Column] | None = None) -> tuple[list[Column], list[Column]]:
    """Codes, null where a test finds nothing, and arrays of codes of the value at a place and of all below it.
    asked: for some keys, the rows that need them."""
    asked = asked or {}
    codes, lists = [], []
    wrong = _wrong(at, rule)
    if wrong is not None:
        codes.append(F.when(wrong, F.lit(rule["path"])))
    if rule["closed"]:
        known = F.array(*[F.lit(k) for k in rule["children"]]).cast("array<string>")
        lists.append(F.transform(F.array_except(at.keys(), known), lambda k: F.concat(F.lit(f"unexpected:{rule['prefix']}"), k)))
    for key in rule["required"]:
        path = f"{rule['prefix']}{key}"
        codes.append(F.when(_is(at.kind, "object") & at.below(key, path, asked.get(key)).kind.isNull(), F.lit(f"missing:{path}")))
    for key, child in rule["children"].items():
        more = _codes(at.below(key, child["path"], asked.get(key)), child)
        codes, lists = codes + more[0], lists + more[1]
    if rule["items"] is not None:
        lists.append(F.flatten(F.transform(at.items(), lambda v: _found(*_codes(Place(v, rule["items"]["path"], None, 0), rule["items"])))))
    return codes, lists


def _found(codes: list[Column], lists: list[Column]) -> Column:
    """All codes as an array without nulls, each once."""
    none = F.array().cast("array<string>")
    found = F.concat(F.array(*codes) if codes else none, *[F.coalesce(x, none) for x in lists])
    return F.array_except(found, F.array(F.lit(None).cast("string")))


def violations_of(lines: DataFrame, schema: Compiled, column: str = "value") -> DataFrame:
    """lines with violations: sorted codes `json` (no object), the telling property (no alternative has its value), `unexpected:<path>`,
    `missing:<path>`, `<path>`; no values."""
    stages = Stages()
    doc, _ = stages.add("value", "", F.try_parse_json(F.col(column)), -1)
    # the type of a whole text is as long as the text, so whether it is an object is told by its map
    root = Place(doc, "", stages, 0, F.lit("OBJECT"))
    fields, level = root.fields()
    kind, asked = F.lit(""), {}
    if schema.tag is not None:
        kind, _ = stages.add("kind", "", _get(F.element_at(fields, schema.tag), "string"), level)
        owners = {key: [name for name, rule in schema.roots.items() if key in rule["children"] or key in rule["required"]] for rule in schema.roots.values() for key in (*rule["children"], *rule["required"])}
        asked = {key: kind.isin(names) for key, names in owners.items() if len(names) < len(schema.roots)}
    codes = F.when(root.keys().isNull(), F.array(F.lit("json")))
    for name, rule in schema.roots.items():
        codes = codes.when(kind == name, _found(*_codes(root, rule, asked)))
    codes = codes.otherwise(F.array(F.lit(schema.tag or "kind")))
    rows = lines
    for stage in stages.stages:
        # with a lambda among its columns a projection stays out of whole-stage code, whose one method for many columns
        # would be longer than the JVM compiles (8,000 bytes), and is split into methods
        apart = {name: F.element_at(F.transform(F.array(c), lambda x: x), 1) for name, c in list(stage.items())[:1] if len(stage) > 8}
        rows = rows.withColumns(stage | apart)
    return rows.withColumn("violations", F.sort_array(codes)).drop(*[name for stage in stages.stages for name in stage])
