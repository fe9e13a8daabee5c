"""The element table: one row per heading, paragraph, list item, table or figure."""

from __future__ import annotations

TITLE, PARAGRAPH, ITEM, TABLE, FIGURE = ("doco:SectionTitle", "doco:Paragraph", "doco:ListItem", "doco:Table", "doco:Figure")

LINKS = "array<struct<uri:string,begin:int,end:int>>"
#: Columns of the element table after the document's key. `seq` counts from 1 in reading order.
ELEMENT = (
    f"seq int, id string, type string, level int, page int, text string, cells array<array<string>>, header_rows int, "
    f"merged_down array<boolean>, merged_left array<boolean>, links {LINKS}, provenance string, evidence string"
)
FIELDS = [f.split()[0] for f in ELEMENT.replace(LINKS, "x").split(", ")]


def element(kind: str, text: str, level: int | None = None, links: list | None = None, **more) -> dict:
    return {"type": kind, "text": text, "level": level, "links": links or [], "page": 0} | more


def table(rows: list[list[str]], header_rows: int | None, down: list[bool] | None = None, left: list[bool] | None = None, **more) -> dict:
    """A table element; its text joins cells with ` | `."""
    return element(
        TABLE,
        "\n".join(" | ".join(r) for r in rows),
        cells=rows,
        header_rows=header_rows,
        merged_down=down if down and any(down) else None,
        merged_left=left if left and any(left) else None,
        **more,
    )


def numbered(elements: list[dict], origin: str) -> list[dict]:
    """Adds sequence, identity and origin, in order of emission."""
    return [{k: e.get(k) for k in FIELDS} | {"seq": i, "id": f"elem-{i:05d}", "provenance": origin, "evidence": e.get("evidence", origin)} for i, e in enumerate(elements, 1)]
