"""A small shop for tests: its records, and an HTTP server that pages them."""

import json
import threading
import urllib.parse
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def cart(i, total, user=3):
    return {"id": i, "userId": user, "total": total, "discountedTotal": total, "totalProducts": 1, "totalQuantity": 1, "products": [{"id": 21, "quantity": 1, "price": total, "total": total, "discountedTotal": total}]}


def bundle():
    return {
        "users": [{"id": 3, "firstName": "Mira", "lastName": "Okafor", "address": {"city": "Porto", "country": "Portugal"}}],
        "products": [{"id": "21", "title": "Desk lamp", "category": "Lighting", "price": 12.5, "stock": 8}],
        "carts": [{"id": 57, "userId": 3, "total": 37.5, "discountedTotal": 30.0, "totalProducts": 1, "totalQuantity": 3, "products": [{"id": 21, "quantity": 3, "price": 12.5, "total": 37.5, "discountedTotal": 30.0}]}],
    }


@contextmanager
def serving(records, change=lambda page: page, status=lambda n, path: (200, {})):
    """(base address, list of paths asked for). change(page) may spoil a page; status(n, path) says what the n-th request gets."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            code, headers = status(len(asked), self.path)
            parts = urllib.parse.urlsplit(self.path)
            name, q = parts.path.strip("/"), dict(urllib.parse.parse_qsl(parts.query))
            limit, skip = int(q["limit"]), int(q["skip"])
            page = change({name: records[name][skip : skip + limit], "total": len(records[name]), "skip": skip, "limit": limit})
            body = json.dumps(page if code == 200 else {}).encode()
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", asked
    finally:
        server.shutdown()
        server.server_close()
