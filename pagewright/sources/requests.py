"""Request payloads: JSON to typed columns with the documented defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.paging import CONFIG_TYPE, config
from pagewright.functions.text import let, nvl, strip
from pagewright.operators.pagination import ACTION_TYPE

_RAW = (
    "struct<url:string,crawl:boolean,actions:array<struct<kind:string,selector:string,value:string,timeout_ms:int,"
    "optional:boolean,notes:string,max_iterations:int,wait_ms:int,scroll_step_px:int>>,session_key:string,"
    "allow_http_probe:boolean,proxy_policy:string,extraction_mode:string,unlock_strategy:string,pagination_mode:boolean,"
    f"pagination:{CONFIG_TYPE},stream_mode:boolean,max_pages:int,max_depth:int,delay:double,output_dir:string>"
)


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def page_action(raw: Column) -> Column:
    """An action with defaults; the waiting time falls back to the timeout if that is given."""
    return F.struct(
        strip(nvl(raw["kind"])).alias("kind"),
        raw["selector"].alias("selector"),
        raw["value"].alias("value"),
        _or(raw["timeout_ms"], 5000).alias("timeout_ms"),
        _or(raw["optional"], False).alias("optional"),
        nvl(raw["notes"]).alias("notes"),
        _or(raw["max_iterations"], 10).alias("max_iterations"),
        F.coalesce(raw["wait_ms"], raw["timeout_ms"], F.lit(1500)).alias("wait_ms"),
        _or(raw["scroll_step_px"], 800).alias("scroll_step_px"),
    ).cast(ACTION_TYPE)


def pagination_config(raw: Column) -> Column:
    """A pagination configuration with defaults, NULL where none was sent."""
    return F.when(
        raw.isNotNull(),
        config(
            type=strip(nvl(raw["type"])),
            param=raw["param"],
            step=_or(raw["step"], 1),
            max_pages=_or(raw["max_pages"], 20),
            next_url=raw["next_url"],
            page_urls=F.coalesce(raw["page_urls"], F.array().cast("array<string>")),
            pattern=raw["pattern"],
            offset_param=raw["offset_param"],
            limit_param=raw["limit_param"],
            limit_value=raw["limit_value"],
            selector=raw["selector"],
            mode=raw["mode"],
            concurrent=_or(raw["concurrent"], False),
            max_workers=_or(raw["max_workers"], 3),
        ),
    )


def scrape_request(payload: Column) -> Column:
    """Typed request of a JSON payload; malformed JSON gives NULL fields and the defaults."""

    def build(r: Column) -> Column:
        actions = F.coalesce(r["actions"], F.array().cast(f"array<{ACTION_TYPE}>"))
        return F.struct(
            r["url"].alias("url"),
            _or(r["crawl"], False).alias("crawl"),
            F.transform(actions, page_action).alias("actions"),
            r["session_key"].alias("session_key"),
            _or(r["allow_http_probe"], True).alias("allow_http_probe"),
            _or(r["proxy_policy"], "sticky").alias("proxy_policy"),
            _or(r["extraction_mode"], "balanced").alias("extraction_mode"),
            _or(r["unlock_strategy"], "unlock_first").alias("unlock_strategy"),
            _or(r["pagination_mode"], False).alias("pagination_mode"),
            pagination_config(r["pagination"]).alias("pagination"),
            _or(r["stream_mode"], False).alias("stream_mode"),
            _or(r["max_pages"], 100).alias("max_pages"),
            _or(r["max_depth"], 3).alias("max_depth"),
            _or(r["delay"], 1.5).alias("delay"),
            _or(r["output_dir"], "storage/extracted").alias("output_dir"),
        )

    return let(F.from_json(payload, _RAW), build)


def flow(request: Column) -> Column:
    """Which run a request asks for."""
    return (
        F.when(request["crawl"] & request["pagination_mode"], F.lit("crawl_with_pagination"))
        .when(request["pagination_mode"], F.lit("pagination"))
        .when(request["crawl"], F.lit("crawl"))
        .otherwise(F.lit("single"))
    )
