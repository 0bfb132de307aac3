"""Rule packs: files of rules, alone or in folders with a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from emberline.plans import ir
from emberline.plans.errors import InvalidRule, RuleError
from emberline.plans.parser import parse
from emberline.schema import SEVERITY_RANK

try:
    import yaml
except ImportError:  # YAML rules are counted as failed then
    yaml = None

_ENDINGS = {".eql", ".json", ".yaml", ".yml"}


@dataclass
class Loaded:
    rules: list[ir.Rule] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def _severity(text) -> str:
    s = str(text or "medium").lower()
    s = {"info": "informational"}.get(s, s)
    if s not in SEVERITY_RANK:
        raise InvalidRule(f"no severity {text}")
    return s


def from_record(data: dict, default_id: str) -> ir.Rule:
    """A rule from a JSON or YAML record: its query in ``eql``, ``query`` or ``condition``, what it is called under ``metadata`` or beside."""
    meta = {**data, **(data.get("metadata") or {})}
    text = data.get("eql") or data.get("query") or (data.get("definition") or {}).get("eql") if not isinstance(data.get("definition"), str) else data["definition"]
    if text:
        rule = parse(text)
    elif "condition" in data:
        rule = ir.Rule((ir.Step(str(data.get("event_type", "")), ir.from_condition(data["condition"])),)).validate()
    else:
        raise InvalidRule("no query")
    rule_id = str(meta.get("rule_id") or meta.get("id") or default_id)
    captures = tuple(ir.Capture(c["field"], c.get("alias", ""), c.get("step")) for c in data.get("captures", ()))
    return replace(
        rule,
        rule_id=rule_id,
        name=str(meta.get("rule_name") or meta.get("name") or rule_id),
        severity=_severity(meta.get("severity")),
        description=str(meta.get("description") or ""),
        tags=tuple(meta.get("tags") or ()),
        captures=captures or rule.captures,
        blockable=bool((data.get("capabilities") or {}).get("requires_block", meta.get("blockable", False))),
        extra={"capabilities": data.get("capabilities") or {}, "version": meta.get("rule_version") or meta.get("version")},
    ).validate()


def load_file(path: str | Path) -> ir.Rule:
    path = Path(path)
    if path.suffix == ".eql":
        manifest = path.with_name("manifest.json")
        data = json.loads(manifest.read_text()) if manifest.exists() else {}
        return from_record({**data, "query": path.read_text()}, path.parent.name if manifest.exists() else path.stem)
    if path.suffix == ".json":
        data = json.loads(path.read_text())
    elif yaml is not None:
        data = yaml.safe_load(path.read_text())
    else:
        raise InvalidRule("YAML can't be read here")
    if not isinstance(data, dict):
        raise InvalidRule("no rule record")
    return from_record(data, path.stem)


def load_all(folder: str | Path, most: int = 1000) -> Loaded:
    """All rules below ``folder``, by path; what can't be loaded is listed with the reason. Manifests belong to the rule beside them."""
    out = Loaded()
    seen: set[str] = set()
    for path in sorted(Path(folder).rglob("*")):
        if not path.is_file() or path.suffix not in _ENDINGS or path.name == "manifest.json":
            continue
        try:
            rule = load_file(path)
            if rule.rule_id in seen:
                raise InvalidRule(f"a second rule {rule.rule_id}")
            if len(out.rules) >= most:
                raise InvalidRule(f"more than {most} rules")
        except (RuleError, ValueError, KeyError, TypeError) as e:
            out.failed[str(path)] = str(e)
        else:
            seen.add(rule.rule_id)
            out.rules.append(rule)
    return out
