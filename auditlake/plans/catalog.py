"""Types of entities and custom columns, how they may change, and who may do what."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import scalars as X
from auditlake.functions.keys import encrypted
from auditlake.operators import search

KINDS = ("text", "number", "json")
PROTECTIONS = ("none", "sha256", "hmac", "rsa")
#: Names that begin so are the engine's own.
RESERVED = "__"


class SchemaError(ValueError):
    """A definition or a row that the catalog refuses."""


class PermissionDenied(PermissionError):
    """A role without the right for an operation."""


@dataclass(frozen=True)
class Field:
    """A field of an entity type; search is none, exact, prefix or ngram with a size."""

    name: str
    kind: str = "text"
    protection: str = "none"
    indexed: bool = False
    required: bool = False
    search: str = "none"
    size: int = 0

    def canonical(self, text: Column) -> Column:
        """The text that fingerprints, digests and comparisons are made of."""
        if self.kind == "number":
            return X.canonical_number(text.try_cast("double"))
        return F.to_json(F.try_parse_json(text)) if self.kind == "json" else text

    def probe(self, value: Any) -> str:
        """The same of a value to search for."""
        if self.kind == "number":
            value = float(value)
            return str(int(value)) if value.is_integer() and abs(value) < 1e15 else X.number_text(value)
        return json.dumps(json.loads(value) if isinstance(value, str) else value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if self.kind == "json" else str(value)

    @property
    def keyed(self) -> bool:
        """Whether tokens are keyed digests."""
        return self.protection in ("hmac", "rsa")

    def protected(self, value: Column, pads: Column | None, data_key: Column | None) -> Column:
        """What is stored of a canonical text; a missing one stays null."""
        if self.protection == "none":
            return value
        made = X.sha256_hex(value) if self.protection == "sha256" else X.hmac_hex(value, pads) if self.protection == "hmac" else encrypted(value, data_key)
        return F.when(value.isNotNull(), made)

    def tokens(self, value: Column, pads: Column | None) -> Column:
        """Digests of the search index, none without one or without a value."""
        none = F.array().cast("array<string>")
        if self.search == "none":
            return none
        made = {"exact": X.exact_tokens, "prefix": lambda c: X.prefix_tokens(c, self.size), "ngram": lambda c: X.ngram_tokens(c, self.size)}[self.search](value)
        return F.when(value.isNotNull(), X.token_digests(self.name, made, pads if self.keyed else None)).otherwise(none)

    def matches(self, value: Column, tokens: Column, probe: Any, mode: str, keys: list[bytes], plain: Column | None = None) -> Column:
        """Whether a version matches, as far as the field's protection and index allow; else an error, never an empty answer.

        `plain` is the decrypted text of an encrypted field, if its keys are held. Without it, and for hashed fields, a search by
        n-grams returns candidates that nothing can verify.
        """
        text = self.probe(probe)
        held: list[bytes | None] = list(keys) if self.keyed else [None]
        if mode == "exact":
            if not self.indexed:
                raise SchemaError(f"{self.name}: not indexed")
            return search.match_keyed(value, text, keys) if self.protection == "hmac" else search.match_hashed(value, text) if self.protection == "sha256" else value == text
        if mode not in ("exact_ci", "prefix", "contains"):
            raise ValueError(f"unknown match mode {mode}")
        if mode == "exact_ci" and self.search == "exact":
            return search.match_tokens(tokens, self.name, [text.lower()], held)
        if mode == "prefix" and self.search == "prefix" and 1 <= len(text) <= self.size:
            return search.match_tokens(tokens, self.name, [text.lower()], held)
        if mode == "contains" and self.search == "ngram":
            return search.match_ngrams(tokens, self.name, text, self.size, held, value if self.protection == "none" else plain)
        if self.protection == "none":
            return search.match(value, text, mode)
        if plain is not None:
            return search.match(plain, text, mode)
        raise SchemaError(f"{self.name}: protected and without an index for {mode}")

    def check(self) -> None:
        if self.kind not in KINDS or self.protection not in PROTECTIONS:
            raise SchemaError(f"{self.name}: unknown kind or protection")
        if self.protection == "rsa" and self.indexed:
            raise SchemaError(f"{self.name}: an encrypted field cannot be indexed for equality")
        if self.search in ("prefix", "ngram") and self.size < 1:
            raise SchemaError(f"{self.name}: the index needs a size of at least 1")
        if self.search != "none" and self.kind != "text":
            raise SchemaError(f"{self.name}: only text can have a search index")


@dataclass(frozen=True)
class CustomColumn:
    """A column of logs; if required, only events at or after `required_since` must have it."""

    name: str
    kind: str = "text"
    required: bool = False
    required_since: int | None = None


@dataclass(frozen=True)
class Catalog:
    """Definitions so far. Changes add: no field goes, and none changes kind, protection, index or search."""

    types: dict[str, tuple[Field, ...]] = field(default_factory=dict)
    columns: dict[str, CustomColumn] = field(default_factory=dict)

    def define_type(self, name: str, fields: tuple[Field, ...]) -> Catalog:
        if name.startswith(RESERVED):
            raise SchemaError(f"{name}: reserved name")
        if len({f.name for f in fields}) < len(fields):
            raise SchemaError(f"{name}: a field is named twice")
        for f in fields:
            f.check()
        now = {f.name: f for f in fields}
        for old in self.types.get(name, ()):
            new = now.get(old.name)
            if new is None:
                raise SchemaError(f"{name}.{old.name}: fields cannot be removed")
            if (new.kind, new.protection, new.indexed, new.search, new.size) != (old.kind, old.protection, old.indexed, old.search, old.size):
                raise SchemaError(f"{name}.{old.name}: kind, protection and index cannot change")
        return replace(self, types=self.types | {name: tuple(fields)})

    def define_column(self, column: CustomColumn, now: int) -> Catalog:
        if column.required and column.required_since is None:
            column = replace(column, required_since=now)
        return replace(self, columns=self.columns | {column.name: column})

    def type_names(self) -> list[str]:
        return sorted(self.types)

    def field(self, type_name: str, name: str) -> Field:
        for f in self.types.get(type_name, ()):
            if f.name == name:
                return f
        raise SchemaError(f"{type_name}.{name}: unknown field")

    def canonical(self, type_name: Column, fields: Column) -> Column:
        """A map of fields in canonical texts, whatever its entity type."""
        return self._by_type(type_name, fields, lambda f, v: f.canonical(v))

    def protected(self, type_name: Column, fields: Column, pads: Column | None, data_key: Column | None) -> Column:
        """A map of canonical texts as it is stored."""
        return self._by_type(type_name, fields, lambda f, v: f.protected(v, pads, data_key))

    def _by_type(self, type_name: Column, fields: Column, make) -> Column:
        out = F.lit(None).cast("map<string,string>")
        for name, known in self.types.items():
            pairs = F.array(*[F.struct(F.lit(f.name).alias("k"), make(f, fields[f.name]).alias("v")) for f in known])
            out = F.when(type_name == name, F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))).otherwise(out)
        return out

    def tokens(self, type_name: Column, fields: Column, pads: Column | None) -> Column:
        """All digests of an entity's search indexes; each names its field."""
        out = F.array().cast("array<string>")
        for name, known in self.types.items():
            made = [f.tokens(fields[f.name], pads) for f in known if f.search != "none"]
            # sort_array, as array_sort calls an interpreted comparator for every pair; no digest is null
            out = F.when(type_name == name, F.sort_array(F.concat(*made))).otherwise(out) if made else out
        return out

    def entity_rules(self, entity: Column) -> Column:
        """The first rule that an entity (entity_type, entity_id, fields) breaks, or null."""
        fields = F.coalesce(entity["fields"], F.create_map().cast("map<string,string>"))
        out = F.when(entity["entity_id"].isNull(), F.lit("missing entity id"))
        for name in self.types:
            for rule, ok in self.field_rules(name, fields).items():
                out = out.when((entity["entity_type"] == name) & ~F.coalesce(ok, F.lit(False)), F.lit(f"{name}: {rule}"))
        return out.when(~F.coalesce(entity["entity_type"].isin(sorted(self.types)), F.lit(False)), F.lit("unknown target type"))

    @property
    def keyed(self) -> bool:
        return any(f.keyed for known in self.types.values() for f in known)

    @property
    def encrypts(self) -> bool:
        return any(f.protection == "rsa" for known in self.types.values() for f in known)

    def field_rules(self, name: str, fields: Column) -> dict[str, Column]:
        """Rules for a map of fields of a type, for `split_valid`."""
        if name not in self.types:
            raise SchemaError(f"{name}: unknown type")
        known = self.types[name]
        names = F.array(*[F.lit(f.name) for f in known])
        rules = {"unknown field": F.size(F.array_except(F.map_keys(fields), names)) == 0}
        for f in known:
            if f.required:
                rules[f"missing {f.name}"] = F.element_at(fields, f.name).isNotNull()
            if f.kind == "number":
                number = F.element_at(fields, f.name).try_cast("double")
                rules[f"{f.name} is no number"] = F.element_at(fields, f.name).isNull() | (number.isNotNull() & ~F.isnan(number))
            if f.kind == "json":
                rules[f"{f.name} is no JSON"] = F.element_at(fields, f.name).isNull() | F.try_parse_json(F.element_at(fields, f.name)).isNotNull()
        return rules

    def custom_rules(self, custom: Column, at: Column) -> dict[str, Column]:
        """Rules for the custom columns of logs with time `at`."""
        names = F.array(*[F.lit(c) for c in self.columns]) if self.columns else F.array().cast("array<string>")
        rules = {"unknown column": custom.isNull() | (F.size(F.array_except(F.map_keys(custom), names)) == 0)}
        for c in self.columns.values():
            value = F.element_at(custom, c.name)
            if c.required:
                rules[f"missing column {c.name}"] = (at < c.required_since) | value.isNotNull()
            if c.kind == "number":
                rules[f"column {c.name} is no number"] = value.isNull() | value.try_cast("double").isNotNull()
        return rules


RIGHTS = ("emit", "query", "administer")


@dataclass(frozen=True)
class Policy:
    """Rights by role; roles without an entry have the default's."""

    roles: dict[str, frozenset[str]] = field(default_factory=dict)
    default: frozenset[str] = frozenset()

    def require(self, role: str, right: str) -> None:
        if right not in self.roles.get(role, self.default):
            raise PermissionDenied(f"{role} may not {right}")
