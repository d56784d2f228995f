"""Per-document helpers that run in Python workers: component trees and XML fields. Imports no Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

GROUPS = ("GR-Organisations", "GR-TenderingParty", "GR-LotTender", "GR-LotResult")
PANELS = "array<struct<grp:string,panel:int,labels:array<string>,vals:map<string,string>>>"


def walk(tree: dict) -> Iterator[tuple]:
    """A tree's nodes in depth-first order; `section`: metadataWrapper or tabs; `grp` and `panel`: of the first group with
    panels; a panel's own row has its labels."""
    found: set[str] = set()
    counter = iter(range(1 << 30))
    seen: set[str] = set()

    def visit(nodes, section, grp, panel) -> Iterator[tuple]:
        for c in nodes if isinstance(nodes, list) else []:
            if not isinstance(c, dict):
                continue
            key, value, n = c.get("key"), c.get("value"), next(counter)
            text = value if isinstance(value, str) or value is None else json.dumps(value)
            yield section, n, key, text, grp, panel, None
            panels = [p for p in c.get("components") or [] if isinstance(p, dict) and str(p.get("key", "")).endswith("_panel")]
            if key in GROUPS and key not in found and panels:
                found.add(key)
                for p in panels:
                    at = next(counter)
                    labels = [str(x) for x in ((p.get("lang") or {}).get("sk") or {}).values()]
                    yield section, at, None, None, key, at, labels
                    yield from visit(p.get("components"), section, key, at)
                rest = [p for p in c.get("components") or [] if not any(p is q for q in panels)]
                yield from visit(rest, section, grp, panel)
            else:
                yield from visit(c.get("components"), section, grp, panel)

    for top in tree.get("components") or []:
        key = top.get("key") if isinstance(top, dict) else None
        section = key if key in ("metadataWrapper", "tabs") and key not in seen else None
        seen.add(key)
        yield from visit(top.get("components") if isinstance(top, dict) and section else [top], section, None, None)


def tree_values(tree: dict, keys: list[str], panel_keys: frozenset[str]) -> tuple[list, list]:
    """The first non-null value of each key, metadata before tabs; and the panels with labels, in order, each with the first
    values of the wanted keys."""
    first: dict[str, tuple] = {}
    panels: dict[int, dict] = {}
    for section, n, key, text, grp, panel, labels in walk(tree):
        if labels is not None:
            panels[panel] = {"grp": grp, "panel": panel, "labels": labels, "vals": {}}
        elif text is not None and isinstance(key, str):
            if panel is not None and key in panel_keys:
                panels[panel]["vals"].setdefault(key, text)
            rank = (section != "metadataWrapper", n)
            if section is not None and (key not in first or rank < first[key][0]):
                first[key] = (rank, text)
    return [first[k][1] if k in first else None for k in keys], [{**p, "vals": list(p["vals"].items())} for p in panels.values()]


XML_FIELDS = "notice_id string, form_type string, root_tag string, procurer_name string, procurer_ico string, estimated_value string, total_value string, currency string, cpv_code string, publication_date string, title string, xml_path string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def extract_xml(path: str, text: bytes | str) -> tuple | None:
    """The eleven fields of a document, by local names; none for one that does not parse or declares entities."""
    raw = text if isinstance(text, bytes) else text.encode()
    if b"<!ENTITY" in raw or b"<!DOCTYPE" in raw:
        return None
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None

    def first(name: str, under=None, **attributes: str) -> str | None:
        for e in (root if under is None else under).iter():
            if isinstance(e.tag, str) and _local(e.tag) == name and all(e.get(k) == v for k, v in attributes.items()) and (e.text or "").strip():
                return e.text.strip()
        return None

    party = next((e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == "ContractingParty"), None)
    amount = next((e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == "EstimatedOverallContractAmount"), None)
    stem = path.rpartition("/")[2].rpartition(".")[0]
    return (
        first("ID") or stem, first("NoticeTypeCode"), _local(root.tag), None if party is None else first("Name", party), None if party is None else first("CompanyID", party), first("EstimatedOverallContractAmount"),
        first("TotalAmount") or first("PayableAmount"), "EUR" if amount is None else amount.get("currencyID") or "EUR", first("ItemClassificationCode", listName="CPV"), first("IssueDate") or first("PublicationDate"), first("Name") or first("Description"), path,
    )
