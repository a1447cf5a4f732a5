"""Request and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.functions.fixed_values import MODES, NO_CONTACTS_ERROR, NO_URLS_ERROR, OUTPUT_FORMATS
from siteroster.functions.urls import extract_urls, is_valid_url
from siteroster.operators.rows import once, unnest
from siteroster.operators.walk import site_walk, walk_counts
from siteroster.session import durable

REQUEST_SCHEMA = (
    "job_id string, input_data string, mode string, output_formats array<string>, "
    "config struct<max_urls_per_domain:int,max_depth:int,request_timeout:int,respect_robots_txt:boolean,"
    "user_agent_alias:string>, ai_settings struct<enabled:boolean,min_confidence:double,categorize_emails:boolean>")

# Allowed ranges and defaults of a request.
RANGES = {
    "config.max_urls_per_domain": (1, 50), "config.max_depth": (1, 5), "config.request_timeout": (5, 60),
    "ai_settings.min_confidence": (0.0, 1.0),
}
DEFAULTS = {
    "mode": "quick", "output_formats": ["csv"],
    "config": {"max_urls_per_domain": 10, "max_depth": 2, "request_timeout": 30, "respect_robots_txt": True,
               "user_agent_alias": "generic_desktop"},
    "ai_settings": {"enabled": False, "min_confidence": 0.7, "categorize_emails": True},
}
MIN_INPUT_LENGTH = 5


def fill_defaults(requests: DataFrame) -> DataFrame:
    """Missing settings take their defaults."""
    def filled(group: str) -> Column:
        return F.struct(*[F.coalesce(F.col(f"{group}.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS[group].items()])
    return requests.withColumns({
        "mode": F.coalesce("mode", F.lit(DEFAULTS["mode"])),
        "output_formats": F.coalesce("output_formats", F.array(*[F.lit(f) for f in DEFAULTS["output_formats"]])),
        "config": filled("config"), "ai_settings": filled("ai_settings")})


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``errors`` (names of the fields that break a rule, in field order) and ``valid``."""
    rules = {
        "input_data": F.coalesce(F.char_length("input_data") < MIN_INPUT_LENGTH, F.lit(True)),
        "mode": ~F.col("mode").isin(MODES),
        "output_formats": F.exists("output_formats", lambda f: ~f.isin(OUTPUT_FORMATS)),
    }
    rules |= {field: ~F.col(field).between(low, high) for field, (low, high) in RANGES.items()}
    errors = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return fill_defaults(requests).withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def request_seeds(requests: DataFrame) -> DataFrame:
    """Target URLs of valid requests with their settings: (job_id, seed, mode, min_confidence, respect_robots)."""
    valid = validate_requests(requests).filter("valid")
    settings = [F.col("ai_settings.min_confidence").alias("min_confidence"), F.col("config.respect_robots_txt").alias("respect_robots")]
    return unnest(valid, ["job_id", "mode", *settings], extract_urls("input_data"), "seed").filter(
        is_valid_url("seed")).select("job_id", "seed", "mode", "min_confidence", "respect_robots")


def job_summary(requests: DataFrame, found: DataFrame) -> DataFrame:
    """contacts_found, status and error per request; ``found`` is (job_id, n).

    A request that breaks a rule is ``rejected`` and never becomes a job; its error names the fields.
    """
    targets = once(validate_requests(requests), {"_targets": F.size(F.filter(extract_urls("input_data"), is_valid_url))})
    error = (F.when(~F.col("valid"), F.concat_ws(",", "errors")).when(F.col("_targets") == 0, F.lit(NO_URLS_ERROR))
             .when(F.coalesce("n", F.lit(0)) == 0, F.lit(NO_CONTACTS_ERROR)))
    status = F.when(~F.col("valid"), "rejected").when(F.col("error").isNull(), "completed").otherwise("failed")
    return targets.join(found.select("job_id", "n"), "job_id", "left").withColumn("error", error).select(
        "job_id", F.coalesce("n", F.lit(0)).alias("contacts_found"), status.alias("status"), "error")


def run_jobs(requests: DataFrame, pages: DataFrame, robots: DataFrame | None = None, captured: str | None = None) -> DataFrame:
    """Walk every valid request from its own targets, with its own mode, threshold and robots switch, and sum up."""
    visits = durable(site_walk(request_seeds(requests), pages, robots, captured=captured), "visits")
    return job_summary(requests, walk_counts(visits, pages, captured))
