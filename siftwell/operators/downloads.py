"""Downloads that a file saves and runs some lines later, graded by where they come from.

Saving and running are events with a file, a line and the saved file's name.
They meet in a range join on the distance of lines: both sides are dealt to
buckets of lines, so equal keys (file, name, bucket) hold a bounded range, and
a file that saves or runs one name a million times forms no pair but those
within reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import basename, found_at, host_of, host_suffixes, settled
from siftwell.operators.lines import line_index

#: Lines below a download within which running its file counts. Fixed value.
REACH = 5
CLASSES = ["hostile", "unknown", "vendor", "illustration", "variable"]
#: Hosts of known installers, with their subdomains. Fixed values.
INSTALLERS = (
    "sh.rustup.rs bun.sh bun.com deno.land deno.com astral.sh get.docker.com get.pnpm.io install.python-poetry.org fnm.vercel.app get.volta.sh get.sdkman.io starship.rs tailscale.com ollama.com "
    "claude.ai opencode.ai pixi.sh mise.run fly.io foundry.paradigm.xyz cli.github.com brew.sh hf.co huggingface.co sh.vercel.com vercel.com get.helm.sh cli.doppler.com aka.ms deb.nodesource.com "
    "rpm.nodesource.com fluxcd.io run.linkerd.io get.k3s.io cli.sentry.dev sdk.cloud.google.com install.determinate.systems nixos.org get.rvm.io"
).split()
#: Owners, or owner and repository, of raw files on GitHub that count as installers. Fixed values.
OWNERS = (
    "Homebrew/install nvm-sh/nvm helm/helm ohmyzsh/ohmyzsh huggingface astral-sh oven-sh microsoft OfficeDev Azure cloudflare vercel anthropics openai google aws hashicorp getsentry supabase cli docker "
    "kubernetes fluxcd linkerd nodesource"
).split()
#: Hosts that stand in examples only. Fixed values.
DEMO = (
    "evil.com evil.org evil.net evil.io attacker.com attacker.org attacker.net attacker.io attacker-controlled.com malicious.com malicious-site.com malicious-domain.com malware.com hacker.com evilcorp.com "
    "evil-server.com attacker-server.com bad.com badsite.com bad-domain.com"
).split()
#: Hosts that take or relay anything without an account, or hide where they lead, and onion addresses. Fixed values.
RELAYS = (
    "ngrok.io ngrok.app ngrok-free.app ngrok-free.dev trycloudflare.com loca.lt localtunnel.me serveo.net pagekite.me bore.pub localhost.run lhr.life telebit.cloud tunnelmole.net "
    "pastebin.com pastebin.pl paste.ee hastebin.com dpaste.com dpaste.org termbin.com ix.io sprunge.us transfer.sh file.io 0x0.st temp.sh catbox.moe gofile.io anonfiles.com bashupload.com oshi.at keep.sh "
    "filebin.net rentry.co rentry.org glot.io paste.c-net.org controlc.com justpaste.it privatebin.net paste.rs pastes.io paste2.org pastelink.net telegra.ph notes.io "
    "webhook.site requestbin.com requestbin.net pipedream.net beeceptor.com hookbin.com requestcatcher.com mockbin.org postb.in interact.sh interactsh.com oast.pro oast.live oast.site oast.online oast.fun "
    "oast.me burpcollaborator.net oastify.com canarytokens.com dnslog.cn ceye.io requestrepo.com webhook.cool onion "
    "duckdns.org no-ip.com no-ip.org no-ip.biz ddns.net hopto.org zapto.org sytes.net servebeer.com dynu.net freedns.afraid.org "
    "bit.ly tinyurl.com t.co goo.gl is.gd cutt.ly rb.gy shorturl.at ow.ly buff.ly tiny.cc v.gd t.ly s.id"
).split()
#: Marks of a URL that stands for another. Fixed values.
PLACEHOLDER = r"\.\.\.|…|[xX]{3,}|<[^>]*>|\{\{|\b(?:your|YOUR)[-_]|\bplaceholder\b|\bchangeme\b"
#: Words too common to tie a host to a skill. Fixed values.
COMMON = (
    "skill skills agent agents tool tools tooling helper helpers setup install installer deploy deployment cloud code coding server client manager management workflow workflows plugin plugins utils util "
    "script scripts config project claude codex github google https http file files data download update auto local remote test tests debug check guide patterns best practices integration service services "
    "platform api apis sdk cli mcp web app apps dev ops"
).split()
#: Hosts whose paths begin with the owner. Fixed values.
FORGES = ["raw.githubusercontent.com", "github.com", "gitlab.com", "codeload.github.com"]
#: Extensions of saved files that are data, not programs. Fixed values.
DATA = (
    "json txt md csv tsv htm html xml yml yaml toml png jpg jpeg gif svg webp pdf tar gz tgz xz bz2 zst 7z zip diff patch dict c cc cpp h hpp rs go java log sql db sqlite parquet onnx bin pt safetensors gguf"
).split()

_URL = r"(?i)https?://[^\s\"'`)|;&<>]+"
_SAVES = r"(?i)\b(?:curl|wget|iwr|Invoke-WebRequest)\b.{0,300}?\s(?:-o\s*|-O\s+|--output(?:-document)?[=\s]\s*|-OutFile\s+)[\"']?[^\s\"'|;&]+"
_SAVED = r"[^\s\"'=]+$"
#: What runs a file, its path as the first group: a right to run, a path as a command, an interpreter, a new process.
_RUNS = [
    r"\bchmod\s+(?:-\w+\s+)*(?:[ugoa]*\+[rw]*x\w*|[0-7]*[1357][0-7]{0,2})\s+[\"']?([^\s\"';&|]+)",
    r"(?:^|[;&|(]|\b(?:then|do|sudo|exec|nohup|time|env)\b)\s*[\"']?((?:\./|/|~/|\$\{?\w+\}?/)[^\s\"';&|]+)",
    r"\b(?:(?:ba|z|k|da)?sh|python[0-9.]*|node|perl|ruby|bun|deno\s+run)\s+(?:-\w+\s+)*[\"']?([^\s\"';&|-][^\s\"';&|]*)",
    r"\bStart-Process\s+[\"']?([^\s\"';&|]+)",
]


def is_under(host: Column, hosts: list[str]) -> Column:
    """Whether a host is one of a list or below it."""
    return F.coalesce(F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(h) for h in hosts])), F.lit(False))


def aligned(url: Column, names: Column) -> Column:
    """Whether a URL is of the vendor that a skill is named after: a word of its names (an array), of four letters or more and not a common one, stands in a label of the host, or in the owner on a forge."""
    words = F.filter(F.flatten(F.transform(names, lambda n: F.split(F.lower(n), "[^a-z0-9]+"))), lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON))
    host = host_of(url)
    owner = F.when(host.isin(*FORGES), F.lower(F.regexp_extract(url, r"(?i)^https?://[^/]+/([^/?#]+)", 1))).otherwise("")
    labels = F.transform(F.concat(F.slice(F.split(host, r"\."), 1, F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1))), F.array(owner)), lambda x: F.replace(x, F.lit("-"), F.lit("")))
    return F.coalesce(F.exists(words, lambda w: F.exists(labels, lambda x: x.contains(w))), F.lit(False))


def download_class(matched: Column, names: Column) -> Column:
    """hostile (no encryption, a bare number, a relay, a paste site or a shortener), illustration (an example's host or a placeholder), vendor (a known installer, or the vendor in the skill's name), variable (no URL but a variable) or unknown."""
    url = F.nullif(F.regexp_extract(matched, f"({_URL})", 1), F.lit(""))
    host = host_of(url)
    installer = is_under(host, INSTALLERS) | F.lower(url).rlike(rf"^https?://raw\.githubusercontent\.com/(?:{'|'.join(o.lower() for o in OWNERS)})/")
    return (
        F.when(url.isNull(), F.when(matched.rlike(r"\$\{?[A-Za-z_]"), "variable").otherwise("unknown"))
        .when(is_under(host, DEMO) | url.rlike(PLACEHOLDER), "illustration")
        .when(url.rlike("(?i)^http://") | host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | is_under(host, RELAYS), "hostile")
        .when(installer | aligned(url, names), "vendor")
        .otherwise("unknown")
    )


#: Severity and confidence by class of a download that is saved and run. Fixed values.
GRADES = {"hostile": (4, 2), "unknown": (3, 1), "vendor": (2, 1), "illustration": (1, 0), "variable": (3, 1)}


def by_class(cls: Column, place: int) -> Column:
    """Severity (place 0) or confidence (1) of a class."""
    out = F.lit(GRADES["unknown"][place])
    for name, grade in GRADES.items():
        out = F.when(cls == name, grade[place]).otherwise(out)
    return out


def saved_files(lines: DataFrame) -> DataFrame:
    """lines' columns with at, matched and name of each download that a line saves; data files, devices and standard output don't count."""
    both = settled(lines.filter(F.col("line_text").rlike(_SAVES)), _m=F.regexp_extract_all("line_text", F.lit(_SAVES), F.lit(0)), _p=F.split("line_text", _SAVES, -1))
    rows = both.withColumn("_f", F.explode(found_at(F.col("_m"), F.col("_p")))).select(*lines.columns, "_f.at", "_f.matched")
    target = F.regexp_extract("matched", _SAVED, 0)
    rows = rows.withColumn("name", basename(target)).filter(~target.rlike("^(?:/dev/|-$)") & (F.length("name") >= 2))
    return rows.filter(~F.lower("name").rlike(rf"\.(?:{'|'.join(DATA)})$"))


def run_names(text: Column) -> Column:
    """Names of the files that a line runs or makes runnable, without folders and repeats."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _RUNS])
    return F.array_distinct(F.filter(F.transform(found, basename), lambda n: n != ""))


def saved_and_run(files: DataFrame, reach: int = REACH) -> DataFrame:
    """bundle_id, file_id, path, kind, role, path_context, line, line_text, at, matched, name and run_line (the nearest) of each download that its file runs behind it on its line or within `reach` lines below."""
    texts = files.filter(F.col("kind").isin("script", "skill-md", "markdown") & F.col("text").rlike(_SAVES))  # what matches in a line does so in its text
    lines = line_index(texts, keep=("bundle_id", "path", "kind", "role", "path_context"))
    saved = saved_files(lines).withColumn("_bucket", F.floor(F.col("line") / (reach + 1)))
    # a line runs for its own bucket of downloads and for the one before
    runs = settled(lines, _names=run_names(F.col("line_text"))).filter(F.size("_names") > 0)
    runs = runs.select(F.col("file_id").alias("_file"), F.col("line").alias("_line"), F.col("line_text").alias("_text"), F.explode("_names").alias("_name"))
    runs = runs.withColumn("_slot", F.explode(F.array(F.floor(F.col("_line") / (reach + 1)), F.floor(F.col("_line") / (reach + 1)) - 1)))
    near = (F.col("file_id") == F.col("_file")) & (F.col("name") == F.col("_name")) & (F.col("_bucket") == F.col("_slot")) & (F.col("_line") >= F.col("line")) & (F.col("_line") <= F.col("line") + reach)
    # on the download's own line, only what stands behind it
    rest = F.expr("substring(_text, at + length(matched) + 1)")
    behind = (F.col("_line") > F.col("line")) | F.array_contains(run_names(rest), F.col("name"))
    pairs = saved.join(runs, near).filter(behind)
    kept = [c for c in saved.columns if c != "_bucket"]
    return pairs.groupBy("file_id", "line", "at", "name").agg(F.min("_line").alias("run_line"), *[F.first(c).alias(c) for c in kept if c not in ("file_id", "line", "at", "name")]).select(*kept, "run_line")


def download_hits(files: DataFrame, names: Column | None = None) -> DataFrame:
    """saved_and_run() with cls, sev and conf: names, an array of the skill's names over files' columns, tells its vendor (by default the bundle's id)."""
    rows = saved_and_run(files)
    cls = download_class(F.col("matched"), F.array(F.col("bundle_id").cast("string")) if names is None else names)
    rows = rows.withColumn("cls", cls)
    return rows.withColumns({"sev": by_class(F.col("cls"), 0), "conf": by_class(F.col("cls"), 1)})
