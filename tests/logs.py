"""Small logs for tests."""

from lodestream.sources.episodes import EPISODES


def episodes(spark, rows):
    """rows: dicts of what differs from an empty episode; lsn is the row's position."""
    out = []
    for i, r in enumerate(rows):
        e = r.get("embedding")
        out.append(
            {
                "lsn": i, "id": r.get("id", f"e{i}"), "ts_hlc": r.get("ms", 1000 + i) << 16, "agent_id": r.get("agent_id", "alice"), "session_id": "s", "kind": r.get("kind", "Observation"), "content": r.get("content", ""),
                "embedding": None if e is None else {"hyp": e[0], "sph": e[1], "euc": e[2]}, "attrs": r.get("attrs", {}), "parents": r.get("parents", []), "valid_from": r.get("valid_from"), "valid_to": r.get("valid_to"),
            }
        )
    return spark.createDataFrame(out, EPISODES)


def edge(a, b, t="pagou", **more):
    return {"attrs": {"edge_from": a, "edge_to": b, "edge_type": t, **more}}
