"""Adapters: tools over one payload or a table of requests, JSON-RPC lines, and a small command line.

Reports come from the DataFrame operators, so one request costs a Spark job; a batch of requests costs one too.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import IO
from urllib.parse import urlparse

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.coerce import flagged_hex
from sedimenta.operators import bytestats, decode, fingerprints, markov, ngrams, polyglot, rules, shellcode, structure, threats
from sedimenta.session import local_session, ship

VERSION = "1.0"
PROTOCOL = "2024-11-05"

TOOLS = {
    "payload_analyze": ("threat report of a payload", ("payload",)),
    "payload_deobfuscate": ("decoded layers of a payload", ("payload",)),
    "payload_entropy": ("byte statistics and window entropies of a payload", ("payload", "window_size")),
    "payload_waf_rules": ("filter rules for a payload", ("payload",)),
    "payload_diagnostics": ("versions and state", ()),
    "payload_polyglot_audit": ("file formats and embedded scripts of a payload", ("payload",)),
    "payload_ast_obfuscation": ("script obfuscation of a payload", ("payload",)),
    "payload_markov_profile": ("n-grams, transitions and fingerprints of a payload", ("payload", "ngram_order")),
    "payload_lsh_fingerprint": ("fingerprints of a payload and their comparison with another", ("payload", "compare_with")),
    "payload_detect_shellcode": ("machine-code indicators of a payload", ("payload", "is_hex")),
}
ROUTES = {
    "/api/analyze": "payload_analyze", "/api/deobfuscate": "payload_deobfuscate", "/api/entropy": "payload_entropy", "/api/waf": "payload_waf_rules", "/api/polyglot": "payload_polyglot_audit", "/api/ast-obfuscation": "payload_ast_obfuscation",
    "/api/markov": "payload_markov_profile", "/api/lsh": "payload_lsh_fingerprint", "/api/shellcode": "payload_detect_shellcode", "/api/diagnostics": "payload_diagnostics",
}


def diagnostics() -> dict:
    return {"tool": "sedimenta", "version": VERSION, "platform": sys.platform, "python_version": sys.version.split()[0], "spark_version": pyspark.__version__, "status": "healthy"}


def reports(tool: str, rows: DataFrame, window: int = 32, order: int = 2) -> DataFrame:
    """The reports of a tool for rows (source, payload_id, payload and, where they matter, is_hex or compare_with)."""
    if tool == "payload_analyze":
        return threats.threat_report(rows)
    if tool == "payload_deobfuscate":
        return decode.deobfuscate(rows)
    if tool == "payload_entropy":
        return bytestats.entropy_profile(rows, window)
    if tool == "payload_waf_rules":
        return rules.waf_rules(rows)
    if tool == "payload_polyglot_audit":
        return polyglot.polyglot_report(rows)
    if tool == "payload_ast_obfuscation":
        return structure.obfuscation_report(rows)
    if tool == "payload_markov_profile":
        grams = ngrams.ngram_frequencies(rows, order).groupBy("source", "payload_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "gram", "freq"))), lambda g: F.struct(g["gram"].alias("gram"), g["freq"].alias("freq"))).alias("ngrams"))
        return markov.profile(rows).join(grams, ["source", "payload_id"], "left")
    if tool == "payload_lsh_fingerprint":
        if "compare_with" in rows.columns:
            return fingerprints.compare(rows.withColumnsRenamed({"payload": "left", "compare_with": "right"}), keys=("source", "payload_id"))
        prints = fingerprints.simhash(rows).drop("bits")
        return prints.join(fingerprints.minhash(rows, 32).withColumnRenamed("signature", "minhash_signature"), ["source", "payload_id"])
    if tool == "payload_detect_shellcode":
        flag = F.coalesce(F.col("is_hex"), F.lit(False)) if "is_hex" in rows.columns else F.lit(False)
        return shellcode.report(rows, flagged_hex(F.col("payload"), flag))
    raise ValueError(f"Unknown tool: {tool}")


def call(spark: SparkSession, tool: str, arguments: dict) -> dict:
    """The report of one payload."""
    if tool == "payload_diagnostics":
        return diagnostics()
    if tool not in TOOLS:
        raise ValueError(f"Unknown tool: {tool}")
    ship(spark)
    payload = str(arguments.get("payload") or "")
    columns = {"payload": payload}
    if arguments.get("compare_with") and tool == "payload_lsh_fingerprint":
        columns["compare_with"] = str(arguments["compare_with"])
    if tool == "payload_detect_shellcode":
        columns["is_hex"] = bool(arguments.get("is_hex", False))
    rows = spark.createDataFrame([("request", 0, *columns.values())], "source string, payload_id long, " + ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in columns.items()))
    made = reports(tool, rows, int(arguments.get("window_size", 32)), int(arguments.get("ngram_order", arguments.get("order", 2))))
    out = json.loads(made.drop("source", "payload_id").toJSON().first())
    if tool == "payload_lsh_fingerprint" and "compare_with" in columns:
        first = call(spark, tool, {"payload": payload})
        return first | {"comparison": {k: v for k, v in out.items() if k != "simhash"}}
    return out


def handle(spark: SparkSession, line: str) -> str | None:
    """The answer to one JSON-RPC line; notifications have none."""

    def answer(ident: object, **body: object) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": ident} | body)

    try:
        request = json.loads(line)
        ident, method, params = request.get("id"), request.get("method"), request.get("params") or {}
    except (ValueError, AttributeError) as e:
        return answer(None, error={"code": -32700, "message": f"Parse error: {e}"})
    if method == "initialize":
        return answer(ident, result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "sedimenta", "version": VERSION}})
    if method == "notifications/initialized":
        return None
    if method == "ping":
        return answer(ident, result={})
    if method == "tools/list":
        kinds = {"window_size": "integer", "ngram_order": "integer", "is_hex": "boolean"}
        tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {a: {"type": kinds.get(a, "string")} for a in some}, "required": ["payload"] * ("payload" in some)}} for n, (d, some) in TOOLS.items()]
        return answer(ident, result={"tools": tools})
    if method == "tools/call":
        try:
            return answer(ident, result={"content": [{"type": "text", "text": json.dumps(call(spark, params.get("name"), params.get("arguments") or {}), indent=2)}]})
        except Exception as e:  # the protocol reports every failure of a tool
            return answer(ident, error={"code": -32603, "message": str(e)})
    return answer(ident, error={"code": -32601, "message": f"Method not found: {method}"})


def serve_lines(spark: SparkSession, source: IO[str], sink: IO[str]) -> None:
    """Answer JSON-RPC lines until the source ends."""
    for line in source:
        if line.strip() and (out := handle(spark, line.strip())):
            sink.write(out + "\n")
            sink.flush()


def is_local(origin: str | None) -> bool:
    """No origin, or http(s) to this machine."""
    try:
        url = urlparse(origin or "http://localhost")
        return url.scheme in ("http", "https") and url.hostname in ("localhost", "127.0.0.1", "::1")
    except ValueError:
        return False


def respond(spark: SparkSession, method: str, path: str, origin: str | None, body: bytes) -> tuple[int, dict]:
    """Status and answer to an HTTP request."""
    if not is_local(origin):
        return 403, {"error": "Cross-origin request blocked"}
    route = urlparse(path).path
    if method == "GET":
        if route in ("/health", "/api/health"):
            return 200, {"status": "ok", "service": "sedimenta", "version": VERSION}
        return (200, diagnostics()) if route == "/api/diagnostics" else (404, {"error": f"Endpoint not found: {route}"})
    try:
        arguments = json.loads(body or b"{}")
        arguments.get("payload")
    except (ValueError, AttributeError):
        return 400, {"error": "Invalid JSON"}
    if route not in ROUTES:
        return 404, {"error": f"Endpoint not found: {route}"}
    try:
        out = call(spark, ROUTES[route], arguments)
    except (TypeError, ValueError) as e:
        return 400, {"error": f"Unusable argument: {e}"}
    except Exception as e:  # an answer rather than a closed connection
        return 500, {"error": f"{type(e).__name__}: {e}"}
    if route == "/api/waf":
        out = {"threat": out["threat"], "severity": out["severity"], "rules": {k: out[k] for k in rules.FAMILIES}}
    return 200, out


def http_server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server of the routes; requests run as Spark jobs of one session."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            length = self.headers.get("Content-Length") or "0"
            if not length.isdecimal():
                self.send_error(400, "Unusable Content-Length")
                return
            body = self.rfile.read(int(length)) if method == "POST" else b""
            status, out = respond(spark, method, self.path, self.headers.get("Origin"), body)
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def safe_join(base: str | Path, *parts: str) -> Path:
    """base / parts, which has to stay below base."""
    root = normalize_path(base)
    target = root.joinpath(*parts).resolve()
    if not target.is_relative_to(root):
        raise PermissionError(f"{target} is outside {root}")
    return target


def normalize_path(path: str | Path) -> Path:
    """The absolute path, with ~ and links resolved; it needn't be there."""
    return Path(path).expanduser().resolve()


def ensure_dir(path: str | Path) -> Path:
    """The normalized path of a folder, made with its parents if it isn't there."""
    folder = normalize_path(path)
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def storage_dir() -> Path:
    """Where reports of one machine go, made if it isn't there."""
    home = Path.home()
    base = Path(os.environ.get("LOCALAPPDATA", home)) / "sedimenta" if sys.platform.startswith("win") else home / "Library/Application Support/sedimenta" if sys.platform == "darwin" else home / ".local/share/sedimenta"
    return ensure_dir(base)


def text_of(value: str) -> str:
    """The text of a file of that name, by the ladder of encodings, or the value itself."""
    if len(value) < 4096 and "\0" not in value and os.path.isfile(value):
        raw = Path(value).read_bytes()
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("latin-1")
    return value


COMMANDS = {"analyze": "payload_analyze", "deobfuscate": "payload_deobfuscate", "entropy": "payload_entropy", "waf": "payload_waf_rules", "polyglot": "payload_polyglot_audit", "ast": "payload_ast_obfuscation", "markov": "payload_markov_profile", "lsh": "payload_lsh_fingerprint", "shellcode": "payload_detect_shellcode"}


#: Other names of commands.
ALIASES = {"lsh": ("simhash", "fingerprint"), "diagnostics": ("doctor", "platform"), "status": (), "rpc": ("mcp",), "serve": ()}


def table(rows: list[list[object]]) -> str:
    """Rows as text, each column as wide as its widest cell."""
    cells = [[" ".join(str(x).split()) for x in row] for row in rows]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in cells)


def as_text(report: dict) -> str:
    """A report as text: its single values as a table of names and values, then a table or a list for each of its lists."""
    single = [[k, v] for k, v in report.items() if not isinstance(v, (dict, list))]
    parts = [table(single)] if single else []
    for name, value in report.items():
        if isinstance(value, dict):
            parts.append(f"{name}\n{as_text(value) if value else '-'}")
        elif isinstance(value, list):
            if value and all(isinstance(x, dict) for x in value):
                names = list(dict.fromkeys(k for x in value for k in x))
                parts.append(f"{name}\n" + table([names, *([x.get(k, "") for k in names] for x in value)]))
            else:
                parts.append(f"{name}\n" + ("\n".join(f"- {x}" for x in value) or "-"))
    return "\n\n".join(parts)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sedimenta")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name, aliases=ALIASES.get(name, ()))
        p.set_defaults(command=name)
        p.add_argument("--text", action="store_true", help="tables instead of JSON")
        p.add_argument("payload", help="text, or the name of a file")
        p.add_argument("-w", "--window-size", type=int, default=32)
        p.add_argument("-n", "--ngram-order", type=int, default=2)
        p.add_argument("-c", "--compare-with")
        p.add_argument("-t", "--type", choices=("all", "modsecurity", "cloudflare", "aws", "suricata"), default="all")
        p.add_argument("--hex", action="store_true")
    for name in ("diagnostics", "status", "rpc", "serve"):
        p = sub.add_parser(name, aliases=ALIASES[name])
        p.set_defaults(command=name)
        p.add_argument("--text", action="store_true", help="tables instead of JSON")
        p.add_argument("--port", type=int, default=8080)
    a = parser.parse_args(args)
    shown = as_text if a.text else lambda out: json.dumps(out, indent=2, ensure_ascii=False)
    if a.command in ("diagnostics", "status"):
        print(shown(diagnostics() if a.command == "diagnostics" else {k: diagnostics()[k] for k in ("tool", "version", "status")}))
        return 0
    spark = spark or local_session(2, "sedimenta")
    if a.command == "rpc":
        serve_lines(spark, sys.stdin, sys.stdout)
        return 0
    if a.command == "serve":
        http_server(spark, port=a.port).serve_forever()
    out = call(spark, COMMANDS[a.command], {"payload": text_of(a.payload), "window_size": a.window_size, "ngram_order": a.ngram_order, "compare_with": a.compare_with, "is_hex": a.hex})
    if a.command == "waf" and a.type != "all":
        print(out["aws_waf" if a.type == "aws" else a.type])
    else:
        print(shown(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
