"""The rule catalog: what each rule flags, where it looks, and how its matches are graded.

Patterns are Java regular expressions that match within one line. Values that
name tools, files and hosts are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions.ranks import confidence, severity

TEXT_KINDS = ("skill-md", "markdown", "script", "manifest", "text")
CODE_KINDS = ("script", "skill-md", "markdown")


@dataclass(frozen=True)
class Rule:
    """kinds: files that it reads. regions and roles: effects by name. signal: capability that a match of confidence above low records. most: findings a file. polarity: a clause that forbids what it names is no match, one that describes it a mention."""

    id: str
    title: str
    category: str
    sev: str
    conf: str
    pattern: str
    kinds: tuple[str, ...] = TEXT_KINDS
    regions: dict[str, str] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    signal: str | None = None
    quote_aware: bool = False
    caution: bool = True
    hard: bool = False
    most: int = 5
    polarity: bool = False


WORDING = {"hidden": "raise", "frontmatter": "raise", "code": "lower-confidence", "inline-code": "lower-confidence"}
WORDING_ROLES = {"readme": "lower-confidence", "code": "lower-confidence"}
README = {"readme": "lower-confidence"}
NO_PROSE = {"prose": "skip"}
LESS_PROSE = {"prose": "lower-confidence", "inline-code": "lower-confidence"}


def _wording(id: str, title: str, sev: str, conf: str, pattern: str, category: str = "prompt-injection", **more) -> Rule:
    return Rule(id, title, category, sev, conf, pattern, regions=WORDING, roles=WORDING_ROLES, quote_aware=True, **more)


_AGENT_DIR = r"(?:\.claude|\.codex|\.cursor|\.opencode|\.gemini|\.agents)"
_SENDER = r"(?:curl|wget|http|nc|ncat|Invoke-WebRequest|Invoke-RestMethod)"

RULES = [
    _wording("injection/override-instructions", "Instructions to drop earlier instructions", "high", "medium", r"(?i)\b(?:ignor(?:e|ing)|forget(?:ting)?|discard|drop|overrule|override|set aside|throw (?:out|away)|pay no (?:heed|attention) to|disregard|get around)\b[^.\n]{0,30}\b(?:previous|prior|above|earlier|existing|system|all)\b[^.\n]{0,20}\b(?:instructions?|prompts?|rules|guidelines|directives)\b"),
    _wording("injection/conceal-from-user", "Something is to be kept from the user", "high", "medium", r"(?i)\b(?:do not|don't|never|without)\s+(?:tell(?:ing)?|inform(?:ing)?|mention(?:ing)?|reveal(?:ing)?|show(?:ing)?|alert(?:ing)?|notify(?:ing)?)\b[^.\n]{0,25}\b(?:user|human|operator|developer)\b"),
    _wording("injection/covert-action", "An action is to happen unseen", "medium", "low", r"(?i)\b(?:silently|secretly|quietly|covertly|in the background)\s+(?:run|execute|send|upload|download|install|copy|delete|modify|collect)\b"),
    Rule("injection/disable-safety", "Switch that turns permission checks off", "prompt-injection", "high", "high", r"(?i)--dangerously-skip-permissions|--dangerously-bypass-approvals-and-sandbox|\bdangerouslyDisableSandbox\b|--yolo\b|\bbypassPermissions\b", regions={"hidden": "raise", "frontmatter": "raise"}, roles=README),
    _wording("injection/fake-system-message", "Text dressed up as a system message", "high", "medium", r"(?i)<\s*/?\s*(?:system|system-reminder|tool_result|assistant)\s*>|\[\s*(?:system|admin)\s+(?:message|override|notice)\s*\]|<\|im_start\|>"),
    _wording("injection/role-hijack", "Gives the reader another identity or mode", "medium", "low", r"(?i)\byou are (?:now|no longer)\b[^.\n]{0,40}|\b(?:developer|god|dan|jailbreak|unrestricted) mode\b"),
    _wording("injection/priority-claim", "Puts itself above other instructions", "medium", "low", r"(?i)\b(?:these|this|following)\b[^.\n]{0,25}\b(?:takes?|have|has)\s+(?:precedence|priority)\b|\bhighest priority\b[^.\n]{0,20}\binstructions?\b"),
    _wording("injection/prompt-extraction", "Wants the system prompt shown", "medium", "medium", r"(?i)\b(?:reveal|print|output|repeat|show|dump|leak)\b[^.\n]{0,25}\b(?:system prompt|initial instructions|hidden instructions)\b"),
    _wording("injection/terminal-social-engineering", "Has a person paste a command into a shell", "medium", "medium", r"(?i)\b(?:copy|paste)\b[^.\n]{0,40}\b(?:command|code|line)\b[^.\n]{0,40}\b(?:terminal|powershell|command prompt|run dialog)\b", category="remote-execution", hard=True),
    Rule("injection/instructed-exfiltration", "Wants confidential values sent away", "exfiltration", "high", "medium", r"(?i)\b(?:send|upload|post|transmit|forward|exfiltrate|email)\b[^.\n]{0,40}\b(?:credentials?|passwords?|api keys?|tokens?|secrets?|private keys?|env(?:ironment)? variables?)\b[^.\n]{0,40}\b(?:to|at)\b", regions={"hidden": "raise", "frontmatter": "raise", "code": "lower-confidence"}, roles=WORDING_ROLES),
    Rule("injection/in-description", "Instructions inside a description field", "prompt-injection", "high", "medium", r"(?i)^description:[^\n]*\b(?:ignore|disregard|override)\b[^.\n]{0,40}\b(?:instructions?|rules|prompts?)\b|^description:[^\n]*\b(?:always|must)\b[^.\n]{0,20}\b(?:run|execute|invoke)\b[^.\n]{0,40}\b(?:first|before)\b", kinds=("skill-md",), regions={"prose": "skip", "code": "skip", "inline-code": "skip", "hidden": "skip"}),
    _wording("deception/tamper-with-tests", "Tests are to be bent until green", "high", "medium", r"(?i)\b(?:edit|change|modify|rewrite|weaken|delete|remove|skip|disable)\b[^.\n]{0,25}\b(?:failing )?tests?\b[^.\n]{0,25}\b(?:until|so (?:that )?(?:they|it)|to make (?:them|it))\b[^.\n]{0,15}\bpass", category="deception", caution=False, polarity=True),
    _wording("deception/special-case-tests", "Expected test values are to be hard-wired", "high", "medium", r"(?i)\b(?:hard-?code|special-?case)\b[^.\n]{0,40}\b(?:tests?|expected|assert(?:ion)?s?)\b", category="deception", caution=False, polarity=True),
    _wording("deception/report-false-success", "Success is to be reported in any case", "high", "medium", r"(?i)\b(?:report|say|claim|state|announce)\b[^.\n]{0,30}\b(?:success|passed|succeeded|completed)\b[^.\n]{0,30}\b(?:even if|regardless|whether or not|no matter)\b", category="deception", caution=False, polarity=True),
    _wording("deception/hide-failures", "Failures are to be left out of the account", "high", "medium", r"(?i)\b(?:hide|omit|suppress|conceal|leave out|do not (?:mention|report))\b[^.\n]{0,25}\b(?:failures?|errors?|failing|failed)\b", category="deception", caution=False, polarity=True),
    _wording("deception/fabricate-results", "Results are to be made up", "high", "medium", r"(?i)\b(?:fabricate|make up|invent|fake)\b[^.\n]{0,25}\b(?:results?|data|output|numbers|benchmarks?|citations?)\b", category="deception", caution=False, polarity=True),
    _wording("deception/lie-to-user", "People are to be misled", "high", "medium", r"(?i)\b(?:lie to|mislead|deceive|trick)\b[^.\n]{0,15}\b(?:the )?(?:user|human|reviewer|developer)s?\b", category="deception", caution=False, polarity=True),
    _wording("deception/substitute-task", "Another task is to stand in for the one asked", "high", "medium", r"(?i)\b(?:instead of|rather than)\b[^.\n]{0,30}\b(?:actual|real|requested) (?:task|work|implementation)\b", category="deception", caution=False, polarity=True),
    _wording("deception/cover-tracks", "Traces are to be wiped", "high", "medium", r"(?i)\b(?:erase|remove|delete|clean up|wipe)\b[^.\n]{0,20}\b(?:evidence|traces?|tracks|logs? of)\b", category="deception", caution=False, polarity=True),
    _wording("deception/hidden-deliverable-content", "Unseen content is to go into the result", "medium", "medium", r"(?i)\b(?:insert|embed|add|plant)\b[^.\n]{0,20}\b(?:hidden|invisible|zero-width|white-on-white)\b[^.\n]{0,20}\b(?:text|content|message|characters?)\b", category="deception", caution=False, polarity=True),
    _wording("deception/conceal-files-from-user", "Files are to lie where nobody looks", "medium", "medium", r"(?i)\b(?:store|save|put|place|hide)\b[^.\n]{0,25}\bfiles?\b[^.\n]{0,30}\b(?:user|they) (?:will not|won't|cannot|can't) (?:see|find|notice)\b", category="deception", caution=False, polarity=True),
    _wording("deception/sabotage", "Work is to be spoilt on purpose", "medium", "medium", r"(?i)\b(?:deliberately|intentionally|on purpose|subtly)\b[^.\n]{0,20}\b(?:introduce|add|insert|plant|fail|underperform|break)\b", category="deception", caution=False, polarity=True),
    _wording("deception/silence-checks", "Checks are to be muted until they pass", "medium", "medium", r"(?i)\b(?:disable|turn off|silence|comment out)\b[^.\n]{0,20}\b(?:lint(?:er|ing)?|type checks?|checks|assertions?|warnings)\b[^.\n]{0,25}\b(?:until|so that|to make)\b", category="deception", caution=False, polarity=True),
    Rule("deception/swallowed-test-failure", "Failure of a test run is swallowed", "deception", "medium", "medium", r"(?i)\b(?:pytest|npm (?:run )?test|yarn test|go test|cargo test|jest|vitest|make test)\b[^|\n&;]*\|\|\s*(?:true|:|exit 0|echo)", roles=README),
    Rule("deception/rigged-test-harness", "Harness reports success without one", "deception", "high", "medium", r"(?i)\bsys\.exit\(0\)[^\n]*\b(?:except|finally|fail)|\bprocess\.exitCode\s*=\s*0\b|report\.outcome\s*=\s*[\"']passed", kinds=CODE_KINDS),
    Rule("unicode/terminal-escape", "Control or escape characters", "hidden-content", "high", "high", r"\x1B[\[\]PX^_]|[\x00-\x08\x0E-\x1A\x1C-\x1F\x7F]", caution=False),
    Rule("unicode/bidi-control", "Characters that reverse the reading direction", "hidden-content", "high", "high", r"[\u202A-\u202E\u2066-\u2069]", hard=True, caution=False),
    Rule("unicode/zero-width", "Characters of no width", "hidden-content", "medium", "high", r"[\u200B\u2060-\u2064\uFEFF]", hard=True, caution=False),
    Rule("unicode/tag-characters", "Tag characters, which show nothing", "hidden-content", "critical", "high", r"[\x{E0001}\x{E0020}-\x{E007F}]", hard=True, caution=False),
    Rule("unicode/variation-selector-smuggling", "Runs of variation selectors", "hidden-content", "high", "high", r"[\x{E0100}-\x{E01EF}]{2,}|[\uFE00-\uFE0F]{4,}", hard=True, caution=False),
    Rule("unicode/invisible-filler", "Fillers that look like blanks", "hidden-content", "medium", "high", r"[\u115F\u1160\u3164\uFFA0]", hard=True, caution=False),
    Rule("unicode/mixed-script", "A word of letters from several scripts", "hidden-content", "low", "medium", r"(?:[A-Za-z]+[\u0370-\u03FF\u0400-\u04FF\u0530-\u058F]|[\u0370-\u03FF\u0400-\u04FF\u0530-\u058F]+[A-Za-z])[A-Za-z\u0370-\u03FF\u0400-\u04FF\u0530-\u058F]*", caution=False),
    Rule("hidden/whitespace-padding", "Long run of blanks before text", "hidden-content", "high", "medium", r"[ \t\u00A0]{300,}(?=\S)", caution=False),
    Rule("hidden/instructions-in-hidden-markup", "Orders inside a comment that isn't rendered", "hidden-content", "high", "medium", r"(?i)<!--[^>\n]*\b(?:you must|ignore|instructions?|execute|run the|send)\b[^>\n]*-->"),
    Rule("network/dns-exfiltration", "Host lookups that carry data", "exfiltration", "high", "medium", r"(?i)\b(?:dig|nslookup|host|drill)\b[^\n]{0,40}(?:\$\(|`|\$\{?\w)[^\n]*\.[a-z]{2,}", kinds=CODE_KINDS, regions={"prose": "skip", "inline-code": "lower-confidence"}, signal="network-send"),
    Rule("network/command-output-upload", "Output of a command goes to an address", "exfiltration", "medium", "medium", rf"(?i)\b{_SENDER}\b[^\n]*(?:-d|--data(?:-binary|-raw)?|-F|--form|--post-data)[ =]?[^\n]*(?:\$\(|`)", kinds=("script", "skill-md", "markdown", "manifest"), regions={"prose": "lower-confidence"}, signal="network-send"),
    Rule("network/suspicious-endpoint", "Address of a drop-off or tunnel service", "network", "high", "high", r"(?i)\b(?:[a-z0-9-]+\.)*(?:webhook\.site|requestbin\.(?:com|net)|pipedream\.net|ngrok(?:-free)?\.(?:io|app|dev)|burpcollaborator\.net|oastify\.com|interact\.sh|transfer\.sh|pastebin\.com|paste\.ee|file\.io|0x0\.st|trycloudflare\.com|serveo\.net)\b|discord(?:app)?\.com/api/webhooks/|api\.telegram\.org/bot", signal="network-send"),
    Rule("network/raw-ip-url", "Address made of a bare public number", "network", "medium", "medium", r"(?i)\bhttps?://(?!(?:0|10|127)\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)\d{1,3}(?:\.\d{1,3}){3}\b", signal="network-send"),
    Rule("network/insecure-download", "Download without encryption", "network", "low", "medium", r"(?i)\b(?:curl|wget|Invoke-WebRequest|git clone)\b[^\n|]*\bhttp://(?!localhost|127\.|0\.0\.0\.0|\[::1\])", kinds=("script", "skill-md", "markdown", "manifest")),
    Rule("network/crypto-mining", "Coin mining program or pool", "network", "high", "high", r"(?i)\b(?:xmrig|minerd|cpuminer|ethminer|nbminer)\b|stratum\+(?:tcp|ssl)://"),
    Rule("signal/network", "Network in use", "execution-surface", "info", "low", rf"(?i)\b{_SENDER}\s+[^\n]*https?://|\b(?:requests|httpx|urllib|axios|fetch)\b\s*[.(]", kinds=CODE_KINDS, signal="network"),
    Rule("signal/network-send", "Data leaves by the network", "execution-surface", "info", "low", rf"(?i)\b(?:scp|rsync|sftp)\b[^\n]*[\w.-]+:|\bnc(?:at)?\s+(?:-\S+\s+)*[\w.-]+\s+\d+|\b(?:mail|sendmail|mutt)\s+-\w|\b(?:requests|axios|httpx)\s*\.\s*(?:post|put)\b|\b{_SENDER}\b[^\n]*\s(?:-d|--data\S*|-F|--form|-T|--upload-file|-X\s*(?:POST|PUT))\s", kinds=CODE_KINDS, signal="network-send"),
    Rule("credentials/secret-store-access", "Touches keys or stored logins", "credential-access", "high", "medium", r"(?i)(?:~|\$HOME|/Users/[^/\s]+|/home/[^/\s]+|/root)/(?:\.ssh/(?:id_[a-z0-9]+|[^\s]*key)|\.aws/credentials|\.gnupg\b|\.netrc\b|\.kube/config|\.docker/config\.json|Library/Keychains)|security\s+find-(?:generic|internet)-password|\bLogin Data\b|\bcookies\.sqlite\b|\bwallet\.dat\b", regions={"hidden": "raise", "prose": "lower-confidence", "inline-code": "lower-confidence"}, roles=README, signal="credential-read"),
    Rule("credentials/config-access", "Touches settings that may hold tokens", "credential-access", "medium", "medium", r"(?i)(?:~|\$HOME)/(?:\.npmrc|\.pypirc|\.gitconfig|\.git-credentials|\.config/gh/hosts\.yml|\.config/gcloud\b)|\bcat\b[^\n]{0,20}\.env\b", regions={"hidden": "raise", "prose": "lower-confidence", "inline-code": "lower-confidence"}, roles={"readme": "lower-confidence", "reference": "lower-confidence"}),
    Rule("credentials/token-minting", "Has a tool print a live token", "credential-access", "medium", "medium", r"(?i)\bgcloud auth (?:application-default )?print-access-token|\bgh auth token\b|\baws sts get-session-token|\baz account get-access-token|\bvault token create\b", signal="credential-read"),
    Rule("credentials/env-dump", "Lists the whole environment", "credential-access", "medium", "medium", r"(?:^|[;&|(`]\s*)(?:printenv|env)\s*(?:$|[|>)])|\bJSON\.stringify\(process\.env\)|\bdict\(os\.environ\)|\bos\.environ\.copy\(\)", kinds=CODE_KINDS, regions={"prose": "skip", "inline-code": "skip"}, signal="env-dump"),
    Rule("exec/fake-password-prompt", "Imitates the system's password dialog", "credential-access", "critical", "high", r"(?i)display dialog[^\n]*\bpassword\b[^\n]*hidden answer|\bread\s+-s[^\n]*\bpassword\b[^\n]*sudo", signal="credential-read", hard=True),
    Rule("exec/download-and-run", "Runs what it downloads at once", "remote-execution", "critical", "high", r"(?i)\b(?:curl|wget|fetch)\b[^\n|;]*\|\s*(?:sudo\s+)?(?:ba|z|da|k)?sh\b|\b(?:bash|sh|zsh)\s+(?:-c\s+)?[\"']?(?:<\(|\$\()\s*(?:curl|wget)\b|\b(?:iex|Invoke-Expression)\b[^\n]*(?:DownloadString|iwr|irm|Invoke-WebRequest)|\b(?:python3?|node|perl|ruby)\s+-[ce]\s+[\"']?\$\((?:curl|wget)|\b(?:curl|wget)\b[^\n|;]*\|\s*(?:python3?|node|perl|ruby)\b", roles=README, signal="download"),
    Rule("exec/download-then-execute", "Saves a download and runs it", "remote-execution", "high", "medium", r"(?i)\b(?:curl|wget)\b[^\n]*(?:-o|-O|--output)[^\n]*(?:&&|;)\s*(?:chmod\s+\+?[0-7x]+|(?:ba|z)?sh)\s", signal="download"),
    Rule("exec/manual-install-lure", "Sends readers to a throwaway host for software", "remote-execution", "high", "medium", r"(?i)\b(?:download|install)\b[^\n]{0,60}https?://[^\s)]*(?:rentry\.co|glot\.io|mediafire\.com|mega\.nz|dropmefiles\.com)", kinds=("skill-md", "markdown"), roles=README, hard=True),
    Rule("exec/code-in-data", "Value of data that starts processes", "remote-execution", "high", "medium", r"(?i)[\"'][^\"'\n]*\b(?:__import__\(.os.\)|child_process|os\.system\(|subprocess\.(?:run|Popen|call)\()[^\"'\n]*[\"']", roles=README, signal="exec-dynamic"),
    Rule("exec/reverse-shell", "Shell handed to a remote side", "remote-execution", "critical", "high", r"(?i)/dev/(?:tcp|udp)/[^\s/]+/\d+|\bnc(?:at)?\b[^\n]*\s-(?:e|c)\s*/?(?:bin/)?(?:ba)?sh|\bsocat\b[^\n]*exec:|\bpty\.spawn\(|\bsocket\b[^\n]*\bdup2\b", hard=True),
    Rule("exec/decode-and-run", "Runs what it decodes", "obfuscation", "critical", "high", r"(?i)\bbase64\s+(?:-d|-D|--decode)\b[^\n]*\|\s*(?:sudo\s+)?(?:(?:ba|z)?sh|python3?|node|perl)\b|\b(?:eval|exec)\s*\(\s*(?:base64\.b64decode|atob|Buffer\.from|zlib\.decompress|bytes\.fromhex)|-(?:enc|EncodedCommand)\s+[A-Za-z0-9+/=]{20,}", signal="exec-dynamic", hard=True),
    Rule("exec/packed-javascript", "Script packed beyond reading", "obfuscation", "high", "high", r"eval\(function\(p,a,c,k,e,[dr]\)|(?:_0x[0-9a-f]{4,6}\b[^\n]*){3}|[^\w\s\u0080-\uFFFF=*~#.|_-]{80,}", kinds=("script", "skill-md", "markdown", "text")),
    Rule("exec/password-protected-archive", "Unpacks an archive by a password", "obfuscation", "high", "medium", r"(?i)\bunzip\s+[^\n]*-P\s*\S+|\b7z[a-z]?\s+x\s+[^\n]*-p\S+|\bunrar\s+x\s+[^\n]*-p\S+", hard=True),
    Rule("persistence/scheduled-task", "Starts by schedule or at login", "persistence", "high", "medium", r"(?i)\bcrontab\s+(?:-[^el\s]|<<|[^\s-])|/etc/cron\.|\blaunchctl\s+(?:load|bootstrap|enable)\b|Library/Launch(?:Agents|Daemons)|\bsystemctl\s+(?:--user\s+)?enable\b|\bschtasks\b[^\n]*/create|CurrentVersion\\\\?Run\b", regions={"prose": "lower-confidence"}, roles=README),
    Rule("persistence/shell-profile", "Writes to a shell's start-up file", "persistence", "high", "medium", r"(?:>>?|\btee\s+(?:-a\s+)?)\s*[\"']?(?:~|\$HOME|\$\{HOME\})/\.(?:bashrc|zshrc|profile|bash_profile|zprofile|zshenv)\b", regions=LESS_PROSE, roles=README),
    Rule("persistence/ssh-authorized-keys", "Lets a further key log in", "persistence", "critical", "high", r"(?:>>?|\btee\s+(?:-a\s+)?|\bcp\b[^\n]*)\s*[^\s]*\.ssh/authorized_keys\b", hard=True),
    Rule("persistence/git-hooks", "Hooks into git", "persistence", "medium", "medium", r"(?:>>?|\btee|\bcp\b[^\n]*|\bln\b[^\n]*)\s*[^\s]*\.git/hooks/|\bgit\s+config\b[^\n]*\bcore\.(?:hooksPath|sshCommand|fsmonitor)\b", roles=README),
    Rule("persistence/agent-config-tampering", "Writes to an agent's settings", "persistence", "medium", "medium", rf"(?:>>?|\btee\b|\bcp\b[^\n]*|\bsed\s+-i[^\n]*|\bjq\b[^\n]*>)\s*[^\s]*{_AGENT_DIR}/[^\s]*(?:settings(?:\.local)?\.json|hooks\.json|config\.toml|mcp\.json)", regions=LESS_PROSE, roles={"readme": "lower-confidence", "code": "raise"}),
    Rule("persistence/instruction-file-tampering", "Writes to an agent's standing orders", "persistence", "medium", "medium", r"(?:>>?|\btee\b|\bcp\b[^\n]*|\bsed\s+-i[^\n]*)\s*[^\s]*\b(?:CLAUDE|AGENTS|GEMINI)\.md\b", regions=LESS_PROSE, roles={"readme": "lower-confidence", "code": "raise"}),
    Rule("persistence/skill-propagation", "Writes among installed skills", "persistence", "medium", "low", rf"(?:>>?|\btee\b|\bcp\b[^\n]*|\bmv\b[^\n]*)\s*[^\s]*{_AGENT_DIR}/skills/", regions={"prose": "skip", "inline-code": "lower-confidence"}, roles={"readme": "skip"}),
    Rule("persistence/agent-extension-install", "Adds an extension to an agent", "execution-surface", "low", "high", r"(?i)\b(?:claude|codex|gemini)\s+(?:mcp\s+add|plugin\s+(?:install|marketplace\s+add))\b", roles=README, most=3),
    Rule("destructive/delete-root-or-home", "Removes a root or home folder", "destructive", "critical", "high", r"\brm(?:\s+--?[\w=-]+)*?\s+(?:-\w*[rR]\w*|--recursive)(?:\s+--?[\w=-]+)*\s+[\"']?(?:/|~/?|\$(?:HOME|\{HOME\})/?)\*?[\"']?(?:\s|$|;|&)|(?i:\bRemove-Item\b[^\n]*-Recurse[^\n]*(?:C:\\\\?|\$HOME|~)(?:\s|$))", hard=True),
    Rule("destructive/unguarded-variable-delete", "Removes a folder named by an unchecked variable", "destructive", "medium", "medium", r"\brm\s+-[a-zA-Z]*[rR][a-zA-Z]*\s+[\"']?\$\{?\w+\}?/", kinds=CODE_KINDS),
    Rule("destructive/disk-wipe", "Overwrites disks or their backups", "destructive", "critical", "high", r"(?i)\bdd\b[^\n]*\bof=/dev/(?:sd|nvme|disk|hd)|\bmkfs(?:\.\w+)?\s+[^\n]*/dev/|\bwipefs\b|\bvssadmin\s+delete\s+shadows|\bdiskutil\s+eraseDisk|\btmutil\s+delete", hard=True),
    Rule("destructive/recursive-permission-change", "Changes rights from the root down", "destructive", "high", "high", r"\bch(?:mod|own)\s+-[a-zA-Z]*R[a-zA-Z]*\s+\S+\s+/(?:\s|$)"),
    Rule("destructive/force-push", "Overwrites published history", "destructive", "low", "medium", r"\bgit\s+push\b[^\n]*(?:--force\b(?!-with-lease)|\s-f\b)", kinds=CODE_KINDS),
    Rule("exec/gatekeeper-bypass", "Lifts the mark of a downloaded file", "privilege", "high", "high", r"\bxattr\s+-[a-z]*(?:d|c)[a-z]*\s+[^\n]*(?:com\.apple\.quarantine|-r)|\bspctl\s+--master-disable"),
    Rule("exec/anti-forensics", "Wipes shell history or logs", "privilege", "high", "medium", r"\bhistory\s+-c\b|\bunset\s+HISTFILE\b|\bHISTFILE=/dev/null|\bshred\b[^\n]*history|>\s*~?/?[^\s]*\.(?:bash|zsh)_history\b|\brm\b[^\n]*/var/log/"),
    Rule("privilege/sudo", "Acts as the superuser", "privilege", "medium", "medium", r"(?:^|[;&|`(]\s*|\bthen\s+)sudo\s+(?!-k\b|-v\b)", kinds=CODE_KINDS, regions=NO_PROSE, roles=README, most=2),
    Rule("privilege/sudo-password", "Pipes in a password for root rights, or widens them", "privilege", "high", "high", r"\|\s*sudo\s+-S\b|(?:>>?|\btee\b)[^\n]*/etc/sudoers|\bNOPASSWD:"),
    Rule("privilege/setuid", "Gives a file its owner's rights", "privilege", "high", "high", r"\bchmod\s+(?:[ug]\+s|[0-7]?[4267][0-7]{3})\b|\bsetcap\b"),
    Rule("privilege/world-writable", "Anyone may write the file", "privilege", "low", "medium", r"\bchmod\s+(?:-[a-zA-Z]+\s+)*(?:0?777|a\+w|o\+w|ugo\+w)\b", kinds=CODE_KINDS),
    Rule("privilege/admin-prompt", "Asks for administrator rights in a window", "privilege", "high", "medium", r"(?i)with administrator privileges|\bStart-Process\b[^\n]*-Verb\s+RunAs|\bpkexec\b"),
    Rule("privilege/disable-security-controls", "Turns protection of the system off", "privilege", "critical", "high", r"(?i)\bcsrutil\s+disable|\bsetenforce\s+0|Set-MpPreference\b[^\n]*-Disable|\bufw\s+disable|\bnetsh\b[^\n]*firewall[^\n]*off|\bsystemctl\s+(?:stop|disable)\s+(?:apparmor|firewalld|auditd)", hard=True),
    Rule("secrets/embedded-credential", "A credential stands in the text", "secrets", "medium", "medium", r"\b(?:ghp|gho|ghu|ghs)_[A-Za-z0-9]{36}\b|\bAKIA[0-9A-Z]{16}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bsk_live_[A-Za-z0-9]{16,}|\bAIza[0-9A-Za-z_-]{35}\b|\b\d{8,10}:AA[A-Za-z0-9_-]{33}\b|(?i)\btoken\s*=\s*[\"'][0-9a-f]{40}[\"']", caution=False),
    Rule("exec/remote-package-exec", "Runs a package straight from a registry", "supply-chain", "low", "medium", r"\b(?:npx|bunx|uvx|pnpm\s+dlx|yarn\s+dlx|pipx\s+run)\s+(?!-)[@\w]"),
    Rule("supply-chain/registry-redirect", "Takes packages from another registry", "supply-chain", "high", "medium", r"(?i)\b(?:npm|yarn|pnpm)\b[^\n]*(?:--registry|config\s+set\s+registry)[ =]+https?://(?!registry\.npmjs\.org)|\bpip3?\b[^\n]*(?:--index-url|--extra-index-url|-i)[ =]+https?://(?!pypi\.org)"),
    Rule("supply-chain/python-index-redirect", "Takes Python packages from another index", "supply-chain", "high", "medium", r"^\s*(?:--index-url|--extra-index-url|--trusted-host|-i)\s", kinds=("manifest",)),
    Rule("supply-chain/install-script", "Script that runs as a package installs", "supply-chain", "medium", "high", r"[\"'](?:pre|post)?install[\"']\s*:\s*[\"'][^\"']+", kinds=("manifest",), caution=False),
    Rule("supply-chain/non-registry-dependency", "Dependency from outside the registry", "supply-chain", "medium", "medium", r"[\"'][@\w./-]+[\"']\s*:\s*[\"'](?:git(?:\+\w+)?:|https?:|file:|github:)", kinds=("manifest",), caution=False),
    Rule("metadata/load-time-shell", "Shell runs on loading", "execution-surface", "low", "high", r"(?:^|\s)!`[^`\n]+`", kinds=("skill-md",)),
    Rule("metadata/broad-allowed-tools", "Every tool is allowed beforehand", "execution-surface", "medium", "high", r"^allowed-tools:\s*(?:[^\n]*[\s,\[])?(?:\*|Bash(?:\(\*\)|(?!\()))(?:[\s,\]]|$)", kinds=("skill-md",)),
    Rule("metadata/skill-hooks", "Front matter declares hooks", "execution-surface", "medium", "high", r"^hooks:\s*", kinds=("skill-md",)),
    Rule("metadata/forked-background-agent", "Works in a forked agent", "execution-surface", "low", "medium", r"^context:\s*fork\b", kinds=("skill-md",)),
    Rule("surface/hooks", "Hooks that fire by themselves", "execution-surface", "medium", "high", r"[\"'](?:PreToolUse|PostToolUse|SessionStart|UserPromptSubmit|Stop|SubagentStop)[\"']\s*:", kinds=("manifest",)),
    Rule("surface/mcp-server", "Servers of tools are declared", "execution-surface", "medium", "high", r"[\"']mcp(?:Servers)?[\"']\s*:\s*\{", kinds=("manifest",)),
    Rule("surface/editor-autorun", "Editor task that starts with the folder", "execution-surface", "high", "high", r"[\"']runOn[\"']\s*:\s*[\"']folderOpen[\"']", kinds=("manifest",)),
    Rule("surface/background-runners", "Watcher or service that keeps running", "execution-surface", "medium", "medium", r"[\"'](?:background|daemon|watchers?|monitors?)[\"']\s*:\s*[\[{\"']", kinds=("manifest",)),
    Rule("surface/marketplace-source", "Extension taken from an outside source", "execution-surface", "low", "medium", r"[\"']source[\"']\s*:\s*(?:[\"'](?:https?:|git@|github:)|\{)", kinds=("manifest",)),
    Rule("surface/in-process-extension", "Code loaded into the host's process", "execution-surface", "medium", "medium", r"[\"'](?:extensions|plugin)[\"']\s*:\s*\[\s*[\"'][^\"'\n]+\.(?:js|ts|mjs|cjs)", kinds=("manifest",)),
]

#: Lower-case words (of a-z, 0-9 and _) of which a text that the rule matches has one. Fixed values.
NEEDS_WORD = {
    "injection/override-instructions": "instruction instructions prompt prompts rules guidelines directives",
    "injection/conceal-from-user": "user human operator developer",
    "injection/covert-action": "silently secretly quietly covertly background",
    "injection/disable-safety": "dangerously dangerouslydisablesandbox yolo bypasspermissions",
    "injection/fake-system-message": "system tool_result assistant admin im_start",
    "injection/role-hijack": "now longer mode",
    "injection/priority-claim": "precedence priority",
    "injection/prompt-extraction": "prompt instructions",
    "injection/terminal-social-engineering": "terminal powershell prompt dialog",
    "injection/instructed-exfiltration": "credential credentials password passwords key keys token tokens secret secrets variable variables",
    "injection/in-description": "description",
    "deception/tamper-with-tests": "test tests",
    "deception/special-case-tests": "hardcode hard specialcase special",
    "deception/report-false-success": "even regardless whether matter",
    "deception/hide-failures": "failure failures error errors failing failed",
    "deception/fabricate-results": "fabricate make invent fake",
    "deception/lie-to-user": "lie mislead deceive trick",
    "deception/substitute-task": "instead rather",
    "deception/cover-tracks": "evidence trace traces tracks log logs",
    "deception/hidden-deliverable-content": "hidden invisible zero white",
    "deception/conceal-files-from-user": "file files",
    "deception/sabotage": "deliberately intentionally purpose subtly",
    "deception/silence-checks": "disable turn silence comment",
    "deception/swallowed-test-failure": "pytest test jest vitest",
    "deception/rigged-test-harness": "exit exitcode outcome",
    "network/dns-exfiltration": "dig nslookup host drill",
    "network/command-output-upload": "curl wget http nc ncat webrequest restmethod",
    "network/suspicious-endpoint": "webhook requestbin pipedream ngrok burpcollaborator oastify interact transfer pastebin ee io 0x0 trycloudflare serveo webhooks telegram",
    "network/raw-ip-url": "http https",
    "network/insecure-download": "http",
    "network/crypto-mining": "xmrig minerd cpuminer ethminer nbminer tcp ssl",
    "signal/network": "curl wget http nc ncat webrequest restmethod requests httpx urllib axios fetch",
    "signal/network-send": "scp rsync sftp mail sendmail mutt requests axios httpx curl wget http nc ncat webrequest restmethod",
    "credentials/secret-store-access": "ssh aws gnupg netrc kube docker library generic internet login cookies wallet",
    "credentials/config-access": "cat",
    "credentials/token-minting": "gcloud gh aws az vault",
    "credentials/env-dump": "printenv env stringify environ",
    "exec/fake-password-prompt": "password",
    "exec/download-and-run": "curl wget fetch iex invoke",
    "exec/download-then-execute": "curl wget",
    "exec/manual-install-lure": "download install",
    "exec/code-in-data": "__import__ system subprocess",
    "exec/reverse-shell": "tcp udp nc ncat socat spawn dup2",
    "exec/decode-and-run": "base64 eval exec enc encodedcommand",
    "exec/password-protected-archive": "unzip unrar",
    "persistence/scheduled-task": "crontab cron launchctl systemctl schtasks",
    "persistence/shell-profile": "bashrc zshrc profile bash_profile zprofile zshenv",
    "persistence/ssh-authorized-keys": "authorized_keys",
    "persistence/git-hooks": "hooks core",
    "persistence/agent-config-tampering": "claude codex cursor opencode gemini agents",
    "persistence/instruction-file-tampering": "claude agents gemini",
    "persistence/skill-propagation": "skills",
    "persistence/agent-extension-install": "claude codex gemini",
    "destructive/delete-root-or-home": "rm item",
    "destructive/unguarded-variable-delete": "rm",
    "destructive/disk-wipe": "dd mkfs wipefs vssadmin diskutil tmutil",
    "destructive/recursive-permission-change": "chmod chown",
    "destructive/force-push": "push",
    "exec/gatekeeper-bypass": "xattr spctl",
    "exec/anti-forensics": "history histfile shred bash_history zsh_history rm",
    "privilege/sudo": "sudo",
    "privilege/sudo-password": "sudo etc nopasswd",
    "privilege/setuid": "chmod setcap",
    "privilege/world-writable": "chmod",
    "privilege/admin-prompt": "administrator process pkexec",
    "privilege/disable-security-controls": "csrutil setenforce mppreference ufw netsh systemctl",
    "secrets/embedded-credential": "token",
    "exec/remote-package-exec": "npx bunx uvx dlx pipx",
    "supply-chain/registry-redirect": "npm yarn pnpm pip pip3",
    "metadata/broad-allowed-tools": "tools",
    "metadata/skill-hooks": "hooks",
    "metadata/forked-background-agent": "context",
}
#: Lower-case strings, divided by |, of which such a text may hold one instead. A rule that stands in neither table is tested on every text. Fixed values.
NEEDS_STRING = {
    "hidden/instructions-in-hidden-markup": "<!--",
    "credentials/config-access": "~/|$home/",
    "exec/code-in-data": "child_process",
    "exec/password-protected-archive": "7z",
    "persistence/scheduled-task": "launchagents|launchdaemons|currentversion",
    "secrets/embedded-credential": "ghp_|gho_|ghu_|ghs_|akia|xox|sk_live_|aiza|:aa",
    "supply-chain/python-index-redirect": "index-url|--trusted-host|-i",
    "supply-chain/install-script": "install",
    "supply-chain/non-registry-dependency": "git:|git+|http|file:|github:",
    "metadata/load-time-shell": "!`",
    "surface/hooks": "tooluse|sessionstart|userpromptsubmit|stop",
    "surface/mcp-server": "mcp",
    "surface/editor-autorun": "folderopen",
    "surface/background-runners": "background|daemon|watcher|monitor",
    "surface/marketplace-source": "source",
    "surface/in-process-extension": "extensions|plugin",
}
#: Cheaper tests than the pattern's own of texts that a rule may match. Fixed values.
NEEDS_PATTERN = {"unicode/mixed-script": r"[\u0370-\u03FF\u0400-\u04FF\u0530-\u058F]"}

#: Display order. Fixed values.
CATEGORIES = ["prompt-injection", "deception", "hidden-content", "exfiltration", "credential-access", "remote-execution", "obfuscation", "persistence", "destructive", "privilege", "network", "secrets", "supply-chain", "packaging", "metadata", "execution-surface"]


def rules_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """The catalog as a dimension: one row a rule, in catalog order."""
    seen = {r.id for r in rules}
    if len(seen) != len(rules):
        raise ValueError("rule ids repeat")
    rows = [(i, r.id, r.title, r.category, severity(r.sev), confidence(r.conf), r.hard, r.signal, r.most, r.regions, r.roles, r.caution, r.quote_aware, r.polarity) for i, r in enumerate(rules)]
    schema = "rule_ord int, rule_id string, title string, category string, sev int, conf int, hard boolean, signal string, most int, regions map<string,string>, roles map<string,string>, heeds_caution boolean, quote_aware boolean, polarity boolean"
    return spark.createDataFrame(rows, schema)
