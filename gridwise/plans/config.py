"""Settings of workflows as JSON: fields with their aliases, column mappings, policies, sensitive columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..operators.headers import Field


@dataclass
class Config:
    """What a project keeps between runs."""

    fields: list[Field] = field(default_factory=list)
    mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    policies: dict[str, dict[str, str]] = field(default_factory=dict)
    sensitive: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> Config:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        raw["fields"] = [Field(**(f | {"aliases": tuple(f["aliases"])})) for f in raw["fields"]]
        return cls(**raw)

    def find(self, words: str) -> list[Field]:
        """Fields whose name or an alias holds the words."""
        w = words.strip().lower()
        return [f for f in self.fields if any(w in x.lower() for x in (f.name, *f.aliases))]

    def counts(self) -> dict[str, int]:
        return {"fields": len(self.fields), "identity": sum(f.identity for f in self.fields), "sensitive": sum(f.sensitive for f in self.fields), "aliases": sum(len(f.aliases) for f in self.fields)}

    def put(self, new: Field) -> None:
        """Add a field, or take the place of the one of its name."""
        at = next((k for k, f in enumerate(self.fields) if f.name == new.name), len(self.fields))
        self.fields[at : at + 1] = [new]

    def remove(self, name: str) -> bool:
        """Take away a field, and the mappings and policies of its name."""
        left = [f for f in self.fields if f.name != name]
        found, self.fields = len(left) < len(self.fields), left
        for table in (self.mappings, self.policies):
            for values in table.values():
                values.pop(name, None)
        self.sensitive = [x for x in self.sensitive if x != name]
        return found

    def alphabetical(self) -> list[Field]:
        return sorted(self.fields, key=lambda f: (f.name.lower(), f.name))
