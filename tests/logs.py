"""Small logs for tests."""

import json

from quillmeter.schemas import COUNTERS


def usage(*counts):
    return dict(zip(COUNTERS, counts, strict=True))


def meta(id_="s1", cwd="/w", at="2026-07-29T00:00:00Z"):
    return {"timestamp": at, "type": "session_meta", "payload": {"id": id_, "cwd": cwd}}


def context(model=None, turn=None, cwd=None):
    return {"type": "turn_context", "payload": {k: v for k, v in (("model", model), ("turn_id", turn), ("cwd", cwd)) if v is not None}}


def tokens(total, last=None, at=None):
    info = {"total_token_usage": total} | ({"last_token_usage": last} if last else {})
    return ({"timestamp": at} if at else {}) | {"type": "event_msg", "payload": {"type": "token_count", "info": info}}


def event(kind, **payload):
    return {"type": "event_msg", "payload": {"type": kind, **payload}}


def write(path, *records, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records) + tail)
    return str(path)
