"""A stand-in for the works API: subfield 2 is large and has two topics."""

from urllib.parse import parse_qs, urlparse

ROWS = {"1": 3, "2": 12}


def answer(address):
    parts = urlparse(address)
    asked = parse_qs(parts.query)
    filters = dict(f.split(":", 1) for f in asked["filter"][0].split(","))
    cursor = asked.get("cursor", ["*"])[0]
    if parts.path.endswith(("/topics", "/subfields")):
        return {"results": [{"id": f"https://api.example/{k}"} for k in (1, 2)] if cursor == "*" else [], "meta": {"next_cursor": "x"}}
    n = ROWS[filters["primary_topic.subfield.id"]] if "primary_topic.subfield.id" in filters else 6
    n = n if filters["open_access.oa_status"] == "gold" else 0
    at = 0 if cursor == "*" else int(cursor)
    rows = [{"id": i} for i in range(at, min(n, at + int(asked["per-page"][0])))]
    return {"results": rows, "meta": {"count": n, "next_cursor": str(at + len(rows)) if rows else None}}
