"""A small HTTP interface to the query service."""

from __future__ import annotations

import json
import socket
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from .options import ROLLING, UsageQuery, parse_bound, rolling, web_limit
from .service import QueryService


def query_of(params: dict[str, str], scopes: dict[str, list[str]] | None = None, now_ms: int | None = None) -> UsageQuery:
    group, zone = params.get("group", "day"), params.get("timezone", "UTC")
    query = UsageQuery(group=group, sort=params.get("sort"), desc={"1": True, "true": True, "0": False, "false": False}.get(params.get("desc", "")), limit=web_limit(params.get("limit"), group), dedupe=params.get("dedupe", "global"), timezone=zone, scope=params.get("scope", "all"))
    span = params.get("range")
    if span in ROLLING:
        start, end = rolling(span, now_ms)
        query = replace(query, from_ms=start, to_ms=end)
    elif span not in (None, "", "all", "custom"):
        raise ValueError(f"invalid range: {span}")
    if params.get("from"):
        query = replace(query, from_ms=parse_bound(params["from"], zone))
    if params.get("to"):
        query = replace(query, to_ms=parse_bound(params["to"], zone, end=True))
    return replace(query, roots=tuple((scopes or {}).get(query.scope, ()))) if query.scope != "all" else query


def handler(service: QueryService, scopes: dict[str, list[str]]):
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, code: int, data: dict) -> None:
            body = json.dumps(data).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def route(self, method: str) -> None:
            url = urlparse(self.path)
            params = {k: v[-1] for k, v in parse_qs(url.query).items()}
            routes = {"/api/usage": "GET", "/api/index/status": "GET", "/api/index/refresh": "POST", "/api/health": "GET"}
            try:
                if url.path not in routes:
                    return self.reply(404, {"error": "not found"})
                if routes[url.path] != method:
                    return self.reply(405, {"error": "method not allowed"})
                if url.path == "/api/health":
                    return self.reply(200, {"ok": True})
                if url.path == "/api/index/status":
                    return self.reply(200, service.index.status())
                roots = scopes.get("all", [])
                if url.path == "/api/index/refresh":
                    if params.get("async") == "1":
                        threading.Thread(target=service.index.refresh, args=(roots,), daemon=True).start()
                        return self.reply(202, service.index.status())
                    service.index.refresh(roots, retry_failures=True)
                    return self.reply(200, service.index.status())
                query = query_of(params, scopes)
                if params.get("refreshIndex") == "1":
                    service.index.refresh(roots)
                return self.reply(200, service.query(query))
            except ValueError as e:
                self.reply(400, {"error": str(e)})
            except Exception as e:
                self.reply(500, {"error": str(e)})

        def do_GET(self):
            self.route("GET")

        def do_POST(self):
            self.route("POST")

    return Handler


def free_port(wanted: int, tries: int = 20, host: str = "127.0.0.1") -> int:
    """The wanted port or the next free one; 0 asks the system."""
    for port in [wanted] if wanted == 0 else range(wanted, wanted + tries):
        with socket.socket() as s:
            s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            try:
                s.bind((host, port))
                return s.getsockname()[1]
            except OSError:
                continue
    raise OSError(f"no free port from {wanted} on")


def serve(service: QueryService, scopes: dict[str, list[str]], port: int = 8787) -> ThreadingHTTPServer:
    server = ThreadingHTTPServer(("127.0.0.1", free_port(port)), handler(service, scopes))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
