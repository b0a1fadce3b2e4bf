"""Queries of release rules, over releases that are written around every row of ``pages``.

For each rule a release either fulfils it or is written to break it, by the
remainder of a number made of its page id and the rule's number.  The SQL side
knows only those remainders and none of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, markup
from ..operators import rules
from .queries import query, table

POLICY = rules.Policy(
    select_id="methodSelect",
    options=("one", "two"),
    metrics_input="liveScores",
    file_input="imageFile",
    file_markers=("Pick a picture", "file-pick"),
    script_markers=("const tolerance = 2", "step <= tolerance"),
    screenshot_path="assets/ui.png",
    build_job="build",
    deploy_job="deploy",
    build_permissions={"contents": "read"},
    deploy_permissions={"pages": "write", "id-token": "write"},
    clean_step="clean site",
    folder_step="make site/web",
    gate_step="check site",
)
PIN = "0123456789abcdef0123456789abcdef01234567"


def broken(rule: int) -> Column:
    """Whether a release breaks the rule."""
    return F.coalesce((F.col("page_id") * (1 + rule % 6) + rule) % 7 == 0, F.lit(False))


BROKEN_SQL = "coalesce((page_id * (1 + ord % 6) + ord) % 7 = 0, false)"


def text(*parts: str | tuple[int, str, str]) -> Column:
    """Parts joined; a triple (rule, wrong, right) is the wrong text where the rule is broken."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.when(broken(p[0]), F.lit(p[1])).otherwise(F.lit(p[2])) for p in parts])


def release_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, name, text) per file of each page's release, and the page itself in its readme."""
    csp = '<meta http-equiv="Content-Security-Policy" content="{}">\n'.format
    description = '<meta name="description" content="{}">\n'.format
    files = {
        "index.html": text('<!doctype html>\n<html lang="', (0, "ja", "en-GB"), '">\n<head>\n', (3, description("   "), description("A launcher.")), (5, "", csp("default-src 'self'")), '<link rel="icon" href="', (13, "//cdn.example/icon.png", "icon.png"), '">\n</head>\n</html>\n'),
        "web/index.html": text(
            "<html class='app' lang='en'>\n<head>\n", (4, "", description("An app.")), (6, csp("default-src 'self'; script-src 'self'"), csp("default-src 'self'; script-src 'self'; style-src 'self'")), "</head>\n<body>\n", (1, "<p>ひらがな</p>\n", "<p>Text</p>\n"),
            '<label class="file-pick">Pick a picture<input id="imageFile" type="', (7, "text", "file"), '"></label>\n', (8, "<p>Pictures are sent to a server.</p>\n", "<p>Pictures are processed locally.</p>\n"), '<input id="liveScores" type="checkbox"', (9, " checked>\n", ">\n"),
            '<select class="list" id="methodSelect"><option value="one">1</option>\n', (10, '<option value="three">3</option>', ""), "<option class=\"x\" value='two'>2</option></select>\n</body>\n</html>\n",
        ),
        "web/app.js": text((2, "const label = 'ラベル';\n", "const label = 'label';\n"), (11, "", "const tolerance = 2;\n"), "const ok = step <= tolerance;\n"),
        "web/styles.css": text((14, '@import url("https://fonts.example/a.css");\n', ""), "p { background: url(paper.png) }\n"),
        "pages.yml": text(
            "on:\n", (15, "  push:\n", "  pull_request:\n"), (16, "  pull_request_target:\n", ""), (19, "permissions: read-all\n", "permissions: {}\n"), "jobs:\n  build:\n    permissions:\n      contents: ", (20, "write", "read"), "\n    steps:\n      - run: ", (17, "scripts/prepare", "true"),
            "\n        uses: tools/checkout@", (18, "v4", PIN), " # pinned\n", (23, "      - run: check site\n      - run: clean site\n", "      - run: clean site\n      - run: check site\n"), "      - run: make site/web\n  deploy:\n", (22, "", "    if: github.event_name != 'pull_request'\n"), "    permissions:\n      pages: write\n      id-token: write\n", (21, "      packages: write\n", ""),
        ),
        "README.md": F.concat(F.coalesce("html", F.lit("")), F.when(broken(12) & (F.col("page_id") % 2 == 0), F.lit('<img src="assets/other.png">')).otherwise(F.lit('<img src="assets/ui.png">'))),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("name"), body.alias("text")) for name, body in files.items()])
    return table(spark, sf_dir, "pages").select("page_id", F.explode(rows).alias("_f")).select("page_id", "_f.*")


FILES = {"launcher_html": "index.html", "app_html": "web/index.html", "app_script": "web/app.js", "styles": "web/styles.css", "workflow": "pages.yml", "readme": "README.md"}


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per release; its screenshot is the head of a picture of the right or a wrong height."""
    found = rules.release_table(release_texts(spark, sf_dir), FILES, ["page_id"])
    height = F.when(broken(12) & (F.col("page_id") % 2 != 0), F.lit("000002D1")).otherwise(F.lit("000002D0"))
    return found.withColumn("screenshot", F.unhex(F.concat(F.lit(binary.PNG_SIGNATURE + "0000000D4948445200000500"), height)))


NAMES_SQL = ", ".join(f"({i}, '{name}')" for i, name in enumerate(rules.NAMES))


@query(f"SELECT page_id, ord, rule, NOT {BROKEN_SQL} AS passed FROM pages, (VALUES {NAMES_SQL}) AS r(ord, rule)")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 rules on a release per page."""
    return rules.evaluate(releases(spark, sf_dir), rules.release_rules(POLICY), ["page_id"])


@query(f"SELECT page_id, string_agg(rule, ', ' ORDER BY ord) AS failed FROM pages, (VALUES {NAMES_SQL}) AS r(ord, rule) WHERE {BROKEN_SQL} GROUP BY 1")
def rule_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of each release that has any, in order."""
    failed = rules.failures(rules.evaluate(releases(spark, sf_dir), rules.release_rules(POLICY), ["page_id"]), ["page_id"])
    return failed.select("page_id", F.array_join("failed", ", ").alias("failed"))


@query("""
SELECT page_id, unnest(range(3))::INTEGER AS ord, unnest(['p' || page_id, 'n' || coalesce(length(html), 0), 'last']) AS value FROM pages
""")
def option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options of one of two lists behind each page's text."""
    number = F.col("page_id").cast("string")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<select class="a" id="methodSelect"><option value="p'), number, F.lit("\">1</option>\n<option class='c' value='n"), F.coalesce(F.length("html"), F.lit(0)).cast("string"), F.lit("'>2</option><option value=\"last\"></option></select><select id=\"other\"><option value=\"no\">3</option></select>"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.option_values(html, POLICY.select_id)).alias("ord", "value"))


@query("""
WITH p AS (SELECT page_id, unnest([{'job': 'build', 'permission': 'contents', 'access': 'read'}, {'job': 'build', 'permission': 'checks', 'access': 'v' || page_id}, {'job': 'build', 'permission': 'pages', 'access': 'none'}, {'job': 'deploy', 'permission': 'pages', 'access': 'write'}, {'job': 'deploy', 'permission': 'id-token', 'access': 'w' || coalesce(length(html), 0)}], recursive := true) FROM pages)
SELECT page_id, job, permission, access FROM p
""")
def permission_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permissions of two jobs of a workflow for each page; of a permission that is named twice the later line holds."""
    workflow = F.concat(
        F.lit("permissions: {}\njobs:\n  build:\n    permissions:\n      contents: write\n      checks: v"), F.col("page_id").cast("string"), F.lit("\n      pages: none # a remark\n      contents: read\n    steps: []\n  deploy:\n    permissions:\n      pages: write\n      id-token: w"), F.coalesce(F.length("html"), F.lit(0)).cast("string"), F.lit("\n")
    )
    jobs = F.array(*[F.struct(F.lit(j).alias("job"), markup.permission_map(markup.job_block(F.col("workflow"), j, after)).alias("m")) for j, after in (("build", "deploy"), ("deploy", None))])
    return table(spark, sf_dir, "pages").select("page_id", workflow.alias("workflow")).select("page_id", F.explode(jobs).alias("j")).select("page_id", "j.job", F.explode("j.m").alias("permission", "access"))
