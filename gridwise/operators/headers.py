"""Headers: logical fields bound to the columns that a sheet really has. Headers are few and live on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field


def normal(header: object) -> str:
    """Lower-case ASCII letters and digits."""
    return re.sub("[^a-z0-9]", "", str(header if header is not None else "").lower())


def trimmed(headers: Iterable[object]) -> list[str]:
    return [str(h if h is not None else "").strip() for h in headers]


@dataclass(frozen=True)
class Field:
    """A logical field: its name, other names, and what it is for."""

    name: str
    aliases: tuple[str, ...] = ()
    policy: str = "fill_blank"
    identity: bool = False
    sensitive: bool = False

    @property
    def names(self) -> set[str]:
        return {normal(x) for x in (self.name, *self.aliases)}


@dataclass(frozen=True)
class Match:
    field: str
    header: str | None
    position: int | None

    @property
    def found(self) -> bool:
        return self.position is not None


def find(headers: list[str], names: Iterable[str], otherwise: Callable[[str], bool] | None = None, fallback: int | None = None) -> int | None:
    """The first header (in the sheet's order) with one of the names; else the first that ``otherwise`` takes; else ``fallback``."""
    wanted = {normal(x) for x in names} - {""}
    for k, h in enumerate(headers):
        if normal(h) in wanted:
            return k
    if otherwise is not None:
        for k, h in enumerate(headers):
            if otherwise(h.strip().lower()):
                return k
    return fallback if fallback is not None and fallback < len(headers) else None


def resolve(headers: list[str], fields: Iterable[Field]) -> list[Match]:
    out = []
    for f in fields:
        at = find(headers, (f.name, *f.aliases))
        out.append(Match(f.name, None if at is None else headers[at], at))
    return out


@dataclass
class Binding:
    """Which source header feeds which target header, under which policy."""

    columns: dict[str, str] = field(default_factory=dict)
    policies: dict[str, str] = field(default_factory=dict)
    protected: list[str] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)
    sensitive: list[str] = field(default_factory=list)


def bind(source: list[str], target: list[str], fields: Iterable[Field]) -> Binding:
    """Fields that both sides carry; those of the source only are unmatched. Identities are never written."""
    out = Binding()
    for f in fields:
        a, b = (find(h, (f.name, *f.aliases)) for h in (source, target))
        if a is not None and b is not None:
            out.columns[source[a]] = target[b]
            out.policies[target[b]] = "never" if f.identity else f.policy
            if f.identity:
                out.protected.append(target[b])
            if f.sensitive:
                out.sensitive.append(target[b])
        elif a is not None:
            out.unmatched.append(f.name)
    return out


def missing(headers: list[str], wanted: Iterable[str]) -> list[str]:
    return [w for w in dict.fromkeys(trimmed(wanted)) if w and w not in headers]


def require(headers: list[str], wanted: Iterable[str]) -> None:
    if lacking := missing(headers, wanted):
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def unique(headers: list[str]) -> list[str]:
    """Names for a DataFrame's columns: blanks and later equal headers get their position."""
    seen: set[str] = set()
    out = []
    for k, h in enumerate(headers):
        name = h if h and h not in seen else f"c{k}"
        seen.add(name)
        out.append(name)
    return out


def add_columns(headers: list[str], wanted: Iterable[str]) -> tuple[list[str], dict[str, int]]:
    """Headers with the missing ones at the right, and the position (from 1) of each that is new."""
    out = list(headers)
    new = {}
    for w in missing(headers, wanted):
        out.append(w)
        new[w] = len(out)
    return out, new


def merge_policies(preset: Mapping[str, str], table: Mapping[str, str], identities: Iterable[str]) -> dict[str, str]:
    """The table's policies over the preset's; identities are never written. None at all is an error."""
    out = {**preset, **table}
    if not out:
        raise ValueError("no column policies were loaded")
    return out | dict.fromkeys(identities, "never")


def column_letter(position: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out, n = "", position + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def policy_table(rows: list[list[object]], known: Callable[[str], bool] = lambda x: bool(x)) -> dict[str, str]:
    """Policies by column from a table whose header stands in one of the first 15 rows, in either column order."""
    for k, row in enumerate(rows[:15]):
        cells = [normal(c) for c in row]
        column = next((i for i, c in enumerate(cells) if c in ("column", "columnname", "header", "field")), None)
        policy = next((i for i, c in enumerate(cells) if c in ("policy", "columnpolicy", "rule")), None)
        if column is not None and policy is not None:
            pairs = [(str(r[column] or "").strip(), str(r[policy] or "").strip()) for r in rows[k + 1 :] if len(r) > max(column, policy)]
            return {c: p for c, p in pairs if c and not c.startswith("(") and known(p)}
    return {}


def mapping_lines(text: str) -> dict[str, str]:
    """A -> B, or A | B, on each line."""
    pairs = (re.split(r"\s*(?:->|\|)\s*", line.strip(), maxsplit=1) for line in (text or "").splitlines())
    return {p[0]: p[1] for p in pairs if len(p) == 2 and all(p)}


def comma_list(text: str) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def with_dashes(header: object) -> str:
    """Lower case with dashes and single spaces kept: dashes of any kind are one, without spaces around."""
    t = re.sub("[\u2010-\u2015]", "-", str(header if header is not None else "").lower())
    return re.sub("[^a-z0-9 -]", "", re.sub(r"\s*-\s*", "-", re.sub(r"\s+", " ", t))).strip()


def yes(value: object) -> bool:
    """A switch of a settings table; blank is on."""
    return str(value or "").strip().lower() in ("", "yes", "y", "true", "enabled")


def a1(tab: str, range_: str = "") -> str:
    """A range with its quoted tab."""
    quoted = "'" + (tab or "").replace("'", "''") + "'"
    return f"{quoted}!{range_}" if range_ else quoted


def schema_names(mappings: Iterable[tuple[str, str]]) -> list[str]:
    """Column names that mappings (source, target) ask of a target, each once: the target's name, else the source's."""
    return [x for x in dict.fromkeys((t or s or "").strip() for s, t in mappings) if x]


# The logical fields of a zone check.
ZONE_FIELDS = {"lat": "Latitude", "lon": "Longitude", "zone": "ZoneName", "contact_name": "NC Name", "contact_phone": "NC Phone", "contact_email": "NC Email", "id": "resident_id", "name": "Resident Name"}


def zone_fields(headers: list[str], fields: Iterable[Field]) -> dict[str, str | None]:
    """The header for each logical field of a zone check, by its name or a dictionary alias; None where there is none."""
    known = {f.name: f for f in fields}
    out = {}
    for role, name in ZONE_FIELDS.items():
        at = find(headers, (name, *(known[name].aliases if name in known else ())))
        out[role] = None if at is None else headers[at]
    return out
