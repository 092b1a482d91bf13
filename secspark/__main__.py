"""``python -m secspark start PATH [--host H] [--port N] [--config FILE]`` and ``python -m secspark health [--url U]``."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="secspark")
    commands = parser.add_subparsers(dest="command", required=True)
    start = commands.add_parser("start", help="serve a store over HTTP")
    start.add_argument("path")
    start.add_argument("--host", default="127.0.0.1")
    start.add_argument("--port", type=int, default=8080)
    start.add_argument("--config", help="a JSON file of settings")
    health = commands.add_parser("health", help="ask a server whether it is up")
    health.add_argument("--url", default="http://127.0.0.1:8080")
    given = parser.parse_args(args)
    if given.command == "health":
        from secspark.errors import SecsparkError
        from secspark.remote import RemoteClient

        try:
            RemoteClient(given.url, 5.0)
        except SecsparkError as e:
            print(f"down: {e}")
            return 1
        print("ok")
        return 0
    from pyspark.sql import SparkSession

    from secspark.client import Client
    from secspark.flow import Config
    from secspark.server import App, serve

    config = Config()
    if given.config:
        with open(given.config) as f:
            config = Config.of(f.read())
    spark = SparkSession.builder.appName("secspark").getOrCreate()
    server = serve(App(Client(spark, given.path, config.storage.window), config.api), given.host, given.port)
    print(f"http://{given.host}:{server.server_port}", flush=True)
    try:
        server.serve_forever()
    finally:
        server.server_close()
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
