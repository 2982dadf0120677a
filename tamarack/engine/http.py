"""The answering service over HTTP, with what Python brings: GET /health, GET /schema, POST /query.

A question whose statement fails is still answered with status 200, and ``ok`` tells;
4xx is a bad request, 503 a service that cannot work. No answer holds a traceback.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tamarack.engine.repair import Service

_MOST_BYTES = 64 * 1024
_FIELDS = {"question": str, "max_rows": int, "repair": bool, "include_rows": bool}


class BadRequest(ValueError):
    """The caller's mistake."""


def _body(raw: bytes) -> dict:
    try:
        found = json.loads(raw or b"{}")
    except ValueError:
        raise BadRequest("the body is no JSON") from None
    if not isinstance(found, dict) or not isinstance(found.get("question"), str):
        raise BadRequest("the body needs a question")
    for name, value in found.items():
        if name not in _FIELDS or not isinstance(value, _FIELDS[name]) or isinstance(value, bool) != (_FIELDS[name] is bool):
            raise BadRequest(f"{name} is no field or has the wrong type")
    return found


def health(service: Service) -> tuple[int, dict]:
    """Runs a query rather than trusting that a session exists."""
    try:
        ok = bool(service.health()["ok"])
    except Exception as error:
        return 503, {"status": "degraded", "engine": False, "detail": type(error).__name__}
    return 200, {"status": "ok" if ok else "degraded", "engine": ok, "generator": type(service.generator).__name__, "schema_fingerprint": fingerprint(service)}


def fingerprint(service: Service) -> str:
    return hashlib.sha256(service.schema.encode()).hexdigest()[:16]


def schema(service: Service) -> tuple[int, dict]:
    """What the generator is shown."""
    return 200, {"fingerprint": fingerprint(service), "characters": len(service.schema), "tables": sorted(service.tables), "schema_text": service.schema}


def query(service: Service, raw: bytes) -> tuple[int, dict]:
    try:
        asked = _body(raw)
        found = service.answer(asked["question"], asked.get("max_rows", 100), asked.get("repair", True))
    except ValueError as error:
        return 422, {"detail": str(error)}
    except Exception as error:
        return 503, {"detail": f"no answer: {type(error).__name__}"}
    out = asdict(found) | {"row_count": len(found.rows)}
    return 200, out if asked.get("include_rows", True) else out | {"rows": []}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            routes = {"/health": health, "/schema": schema}
            self._send(*(routes[self.path](service) if self.path in routes else (404, {"detail": "no such page"})))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/query":
                self._send(404, {"detail": "no such page"})
            elif size > _MOST_BYTES:
                self._send(413, {"detail": "the body is too long"})
            else:
                self._send(*query(service, self.rfile.read(size)))

        def log_message(self, *args: object) -> None:
            """Requests are not logged: questions may be private."""

    return ThreadingHTTPServer((host, port), Handler)
