"""Contract, rule and deadline files.  Configuration, read on the driver."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from tableward.operators.contracts import Contract, ContractColumn
from tableward.operators.freshness import Sla
from tableward.operators.rules import Rule

REGISTRY_DDL = (
    "contract_id string, version string, source string, additional_properties boolean, "
    "column_name string, column_type string, criticality string, nullable boolean, "
    "is_unique boolean, min_length int, max_length int, minimum double, maximum double, "
    "pattern string, enum_values array<string>, precision int, scale int, foreign_key string"
)


def _load(path: str):
    text = Path(path).read_text(encoding="utf-8")
    return json.loads(text) if path.endswith(".json") else yaml.safe_load(text)


def contract_from(schema: dict) -> Contract:
    """A contract from JSON Schema with identity and criticality as extensions.

    Two layouts are read: ``x-contract-id``/``x-version``/``x-source`` with criticality on each
    property, and plain ``id``/``version``/``source`` with one map of criticalities.
    """
    shared = schema.get("criticality") or schema.get("x-column-criticality") or {}
    required = set(schema.get("required", []))
    columns = []
    for name, p in schema.get("properties", {}).items():
        kind = p.get("type", "string")
        nullable = name not in required
        if isinstance(kind, list):
            nullable = nullable or "null" in kind
            kind = next((k for k in kind if k != "null"), "string")
        if kind == "string":
            kind = {"date": "date", "date-time": "datetime"}.get(p.get("format"), kind)
        importance = p.get("x-column-criticality") or (shared.get(name) if isinstance(shared, dict) else None)
        columns.append(ContractColumn(
            name, kind, required=(importance == "required") if importance else name in required,
            nullable=nullable, unique=bool(p.get("x-unique", False)), min_length=p.get("minLength"),
            max_length=p.get("maxLength"), minimum=p.get("minimum"), maximum=p.get("maximum"),
            pattern=p.get("pattern"), enum=tuple(p["enum"]) if "enum" in p else None,
            precision=p.get("x-precision"), scale=p.get("x-scale"), foreign_key=p.get("x-foreign-key")))
    pick = lambda name: schema.get(f"x-{name}") or schema.get(name) or ""
    return Contract(schema.get("x-contract-id") or schema.get("id") or schema.get("title", ""), pick("version"),
                    pick("source"), tuple(columns), bool(schema.get("additionalProperties", False)))


def contract_to(contract: Contract) -> dict:
    """The JSON Schema of a contract."""
    properties = {}
    for c in contract.columns:
        kind = {"date": "string", "datetime": "string"}.get(c.type, c.type)
        p = {"type": [kind, "null"] if c.nullable else kind, "format": {"date": "date", "datetime": "date-time"}.get(c.type),
             "minLength": c.min_length, "maxLength": c.max_length, "minimum": c.minimum, "maximum": c.maximum,
             "pattern": c.pattern, "enum": list(c.enum) if c.enum else None,
             "x-column-criticality": "required" if c.required else "optional", "x-unique": c.unique or None,
             "x-precision": c.precision, "x-scale": c.scale, "x-foreign-key": c.foreign_key}
        properties[c.name] = {k: v for k, v in p.items() if v is not None}
    return {"x-contract-id": contract.id, "x-version": contract.version, "x-source": contract.source, "type": "object",
            "properties": properties, "required": [c.name for c in contract.columns if c.required and not c.nullable],
            "additionalProperties": contract.additional_properties}


def read_contract(path: str) -> Contract:
    return contract_from(_load(path))


def contract_table(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """Contracts as registry rows, so that versions can be compared by joins."""
    rows = [
        (k.id, k.version, k.source, k.additional_properties, c.name, c.type, "required" if c.required else "optional",
         c.nullable, c.unique, c.min_length, c.max_length,
         None if c.minimum is None else float(c.minimum), None if c.maximum is None else float(c.maximum),
         c.pattern, [str(e) for e in c.enum] if c.enum else None, c.precision, c.scale, c.foreign_key)
        for k in contracts for c in k.columns
    ]
    return spark.createDataFrame(rows, REGISTRY_DDL)


def rule_from(entry: dict) -> Rule:
    """A rule; older spellings of the temporal keys are read too."""
    kind = entry.get("type", "domain")
    fields = entry.get("fields") or ([entry["field"]] if entry.get("field") else [])
    parameters = entry.get("parameters") or {}
    return Rule(
        id=entry["id"], kind=kind, expression=entry.get("expression", ""), name=entry.get("name", ""),
        fields=tuple(fields), severity=entry.get("severity", "WARNING").upper(), code=entry.get("failure_code", ""),
        condition=entry.get("condition"), tolerance=float(entry.get("tolerance", 0.001)),
        check=parameters.get("check_type") or entry.get("rule", ""), enabled=entry.get("enabled", True),
        priority=int(entry.get("priority", 0)), reference=entry.get("reference", ""),
        allowed=tuple(entry.get("allowed_values") or ()),
        transitions=tuple((k, tuple(v or ())) for k, v in (entry.get("transitions") or {}).items()),
        entity=entry.get("entity") or parameters.get("entity", ""),
        order=tuple(entry.get("order") or parameters.get("order") or ()))


def read_rules(path: str) -> list[Rule]:
    return [rule_from(e) for e in _load(path).get("rules", [])]


def sla_from(entry: dict) -> Sla:
    limits = entry.get("freshness_threshold") or entry
    return Sla(
        entry["id"], entry["source"], entry.get("schedule", "0 * * * *"), int(limits.get("warning_minutes", 60)),
        int(limits.get("critical_minutes", 90)), int(entry.get("latency_threshold_seconds") or entry.get("latency_threshold", 1800)),
        entry.get("expected_record_count"), entry.get("enabled", True))


def read_slas(path: str) -> list[Sla]:
    content = _load(path)
    entries = content.get("slas") or content.get("sla_definitions") or []
    return [sla_from(e) for e in entries]
