"""Kind, language, role and path context of files, and magic numbers of binaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import basename, extension

#: Language by extension. Fixed values.
LANGUAGES = {
    "shell": "sh bash zsh ksh fish command", "python": "py pyw", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts tsx", "powershell": "ps1 psm1 psd1",
    "batch": "bat cmd", "ruby": "rb", "perl": "pl pm", "php": "php", "applescript": "applescript scpt",
}
#: Interpreters of a first line that begins with #!. Fixed values.
INTERPRETERS = {"shell": "sh|bash|zsh|ksh|dash|fish", "python": r"python[\d.]*|uv", "javascript": "node|bun", "typescript": "deno|tsx|ts-node", "ruby": "ruby", "perl": "perl", "php": "php", "applescript": "osascript", "powershell": "pwsh"}
MARKDOWN = "md mdx markdown".split()
MANIFESTS = ["package.json", "plugin.json", "marketplace.json", "hooks.json", ".mcp.json", "settings.json", "opencode.json", "pyproject.toml", "requirements.txt", "setup.py", "tasks.json"]
#: Extensions whose files are not text. Fixed values.
BINARY = (
    "png jpg jpeg gif bmp ico webp tif tiff pdf zip gz tgz bz2 xz 7z rar jar war tar zst woff woff2 ttf otf eot mp3 mp4 m4a wav ogg flac avi mov mkv webm "
    "exe dll so dylib bin o a class pyc pyo wasm node db sqlite sqlite3 doc docx xls xlsx ppt pptx odt ods odp"
).split()
#: Format by the first bytes, in hexadecimal. Fixed values.
MAGIC = {
    "elf": "7F454C46", "pe": "4D5A", "macho": "CFFAEDFE", "macho-32": "CEFAEDFE", "macho-fat": "CAFEBABE", "wasm": "0061736D", "zip": "504B0304", "zip-empty": "504B0506", "gzip": "1F8B",
    "bzip2": "425A68", "xz": "FD377A585A00", "7z": "377ABCAF271C", "rar": "526172211A07", "pdf": "25504446", "png": "89504E470D0A1A0A", "gif": "47494638", "jpeg": "FFD8FF",
    "ole": "D0CF11E0A1B11AE1", "sqlite": "53514C69746520666F726D6174",
}
EXECUTABLE = ["elf", "pe", "macho", "macho-32", "macho-fat", "wasm"]
ARCHIVES = ["zip", "zip-empty", "gzip", "bzip2", "xz", "7z", "rar"]


def language(path: Column, head: Column) -> Column:
    """By the interpreter of the first line, else by the extension; null for neither."""
    out = None
    for name, program in INTERPRETERS.items():
        hit = head.rlike(rf"^#!\s*\S*?(?:/|\benv\s+(?:-S\s+)?)(?:{program})\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, extensions in LANGUAGES.items():
        out = out.when(extension(path).isin(*extensions.split()), name)
    return out


def is_skill_file(path: Column) -> Column:
    return F.lower(basename(path)) == "skill.md"


def kind(path: Column, head: Column, binary: Column) -> Column:
    """binary, skill-md, manifest, markdown, script or text."""
    return (
        F.when(binary | extension(path).isin(*BINARY), "binary")
        .when(is_skill_file(path), "skill-md")
        .when(F.lower(basename(path)).isin(*MANIFESTS), "manifest")
        .when(extension(path).isin(*MARKDOWN), "markdown")
        .when(language(path, head).isNotNull(), "script")
        .otherwise("text")
    )


def binary_format(content: Column, path: Column | None = None) -> Column:
    """Format by the first bytes; null for none of the known ones. Class files begin as fat Mach-O files do: the extension tells them apart."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for name, magic in MAGIC.items():
        out = F.when(head.startswith(magic), name) if out is None else out.when(head.startswith(magic), name)
    return out if path is None else F.when((out == "macho-fat") & (extension(path) == "class"), "java-class").otherwise(out)


def looks_binary(content: Column) -> Column:
    """A zero byte, or over a tenth control bytes, in the first 8192 bytes."""
    head = F.hex(F.substring(content, 1, 8192))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    control = F.regexp_count(pairs, F.lit(r"\b(?:0[0-8BEF]|1[0-9A-F]|7F) "))
    return F.coalesce(pairs.rlike(r"\b00 ") | (control * 10 > F.octet_length(F.substring(content, 1, 8192))), F.lit(False))


def role(path: Column, file_kind: Column) -> Column:
    """instructions, reference, readme, code, manifest or other."""
    return (
        F.when(file_kind == "skill-md", "instructions")
        .when(F.lower(basename(path)).rlike(r"^(?:readme|changelog|license|contributing|security)\b"), "readme")
        .when(file_kind == "manifest", "manifest")
        .when(file_kind == "script", "code")
        .when(file_kind == "markdown", "reference")
        .otherwise("other")
    )


def path_context(path: Column, file_kind: Column | None = None) -> Column:
    """educational (of prose files alone, where the kind is given), container or dev where the path says so; else null."""
    prose = F.lit(True) if file_kind is None else file_kind.isin("markdown", "text")
    p = F.lower(path)
    return (
        F.when(prose & p.rlike(r"(?:^|/)(?:examples?|tutorials?|samples?|demos?|ctf|labs?|exercises?)(?:/|$)"), "educational")
        .when(p.rlike(r"(?:^|/)(?:dockerfile[^/]*|[^/]*\.dockerfile|docker-compose[^/]*|\.devcontainer)(?:/|$)"), "container")
        .when(p.rlike(r"(?:^|/)(?:tests?|__tests__|specs?|fixtures?|\.github|ci|benchmarks?)(?:/|$)|(?:^|/)test_[^/]*$|\.(?:test|spec)\.[^/]+$"), "dev")
    )
