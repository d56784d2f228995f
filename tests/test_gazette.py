"""The gazette transform works within an item."""

import json

from tenderspark.sources import readers, transforms


def panel(kind, label, **values):
    return {"key": f"{kind}_panel", "lang": {"sk": {"a": f"Panel ({label})"}}, "components": [{"key": k, "value": v} for k, v in values.items()]}


def tree(title, *orgs):
    name, cin = "BT-500-Organization-Company", "BT-501-Organization-Company-CIN"
    groups = [
        {"key": "GR-Organisations", "components": [panel("org", label, **{name: n, cin: c}) for label, n, c in orgs]},
        {"key": "GR-TenderingParty", "components": [panel("tpa", "TPA-1", **{"OPT-300-Tenderer": "ORG-2"})]},
        {"key": "GR-LotTender", "components": [panel("ten", "TEN-1", **{"OPT-310-Tender": "TPA-1", "BT-720-Tender_value": v}) for v in ("1", "2.5")]},
        {"key": "GR-LotResult", "components": [panel("res", "RES-1", **{"BT-142-LotResult": "selec-w", "OPT-320-LotResult": "['TEN-1', 'TEN-9']"})]},
    ]
    meta = {"key": "metadataWrapper", "components": [{"key": "DL-Metadata-Order", "value": title}, {"key": "DL-Metadata-Partner", "value": "buyer (ID: 1)"}]}
    return json.dumps({"id": 7, "components": [{"key": "tabs", "components": groups}, meta]})


def test_items_need_no_shuffle_and_stay_apart(spark, capsys):
    texts = [tree("A", ("ORG-1", "Buyer", "12345678"), ("ORG-2", "Old", "1"), ("ORG-2", "Won", "87654321")), tree("B", ("ORG-3", "Other", "1"))]
    items = readers.bulletin_items(spark.createDataFrame([("2024-01-02", 2024, 5, [(x,) for x in texts])], readers.ENVELOPE))
    df = transforms.nkod_notices(items)
    df.explain()
    assert "Exchange" not in capsys.readouterr().out
    got = {r.title: (r.procurer.name, r.procurer.ico, [(a.supplier.name, a.supplier.ico, a.value) for a in r.awards]) for r in df.collect()}
    assert got == {"A": ("Buyer", "12345678", [("Won", "87654321", 2.5)]), "B": ("buyer", None, [])}
