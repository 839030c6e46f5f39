"""Rule catalogue: what is looked for, how severe it is and what to do about it.

The needles, regular expressions, severities, categories and CWE numbers are fixed
values; titles and advice are prose. ``rule_rows()`` flattens everything to one row per
needle / expression / detector, which is the shape every operator works with.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from scanframe.schemas import RULES

# --- fixed values: the ten categories -------------------------------------------------
CATEGORIES = [
    "A01_Broken_Access_Control",
    "A02_Cryptographic_Failures",
    "A03_Injection",
    "A04_Insecure_Design",
    "A05_Security_Misconfiguration",
    "A06_Vulnerable_Components",
    "A07_Auth_Failures",
    "A08_Integrity_Failures",
    "A09_Logging_Failures",
    "A10_SSRF",
]
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]

# --- fixed values: line rules (category, severity, needles) ---------------------------
LINE_RULES = [
    ("A01_Broken_Access_Control", "High", ["@PreAuthorize", "hasRole", "permitAll"]),
    ("A02_Cryptographic_Failures", "High", ["MD5", "SHA1", "DES", "ECB"]),
    ("A03_Injection", "Critical", ["execute(", "eval(", "exec(", "Runtime.getRuntime"]),
    ("A04_Insecure_Design", "Medium", ["TODO", "FIXME", "XXX"]),
    ("A05_Security_Misconfiguration", "Medium", ["debug=True", "DEBUG=true", "printStackTrace"]),
]
LINE_TITLES = {
    "A01_Broken_Access_Control": "Access rule that deserves a second look",
    "A02_Cryptographic_Failures": "Outdated cryptographic primitive",
    "A03_Injection": "Call that may run attacker-supplied input",
    "A04_Insecure_Design": "Marker of unfinished work",
    "A05_Security_Misconfiguration": "Setting that should not reach production",
}


#: What may happen where a rule of the category is right.
IMPACT = {
    "A01_Broken_Access_Control": "People see or change records that are not theirs",
    "A02_Cryptographic_Failures": "Protected data can be read or forged",
    "A03_Injection": "Input is run as code, as a command or as a query",
    "A04_Insecure_Design": "A missing safeguard cannot be patched in later without rework",
    "A05_Security_Misconfiguration": "Internals are exposed to anyone who asks",
    "A06_Vulnerable_Components": "Known holes of an old dependency are open here as well",
    "A07_Auth_Failures": "Accounts can be taken over",
    "A08_Integrity_Failures": "Foreign data or packages run with the program's rights",
    "A09_Logging_Failures": "An attack goes unnoticed and cannot be traced",
    "A10_SSRF": "The server can be made to call internal systems",
}


@dataclass(frozen=True)
class Group:
    """Needles and expressions that share category, severity and advice.

    ``regexes`` holds ``(expression, dot_matches_newline, needs)``. ``needs`` is a list of
    alternatives lists: text can only match when, for each list, it contains one of the
    alternatives (ignoring case). It lets a scan skip the expression cheaply.
    """

    key: str
    category: str
    subcategory: str
    severity: str
    literals: list
    regexes: list
    cwe_ids: list
    title: str
    advice: str
    ref: str


_DML = ["select", "insert", "update", "delete"]
_SECRETS = ["password", "secret", "key", "token"]

# --- fixed values: content rules (needles, expressions, severities, CWE numbers, links) ------
GROUPS = [
    Group(
        "A01-authz", "A01_Broken_Access_Control", "Missing Authorization", "High",
        ["@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "app.route",
         "flask.route", "def get(", "def post(", "def put(", "def delete("],
        [(r"@(Get|Post|Put|Delete|Request)Mapping(?!\s*\([^)]*authorize)", False, [["mapping"]]),
         (r"@app\.route(?!\s*\([^)]*login_required)", False, [["@app.route"]]),
         (r"def\s+(get|post|put|delete)\s*\([^)]*\):(?!.*@login_required)", True,
          [["def"], ["get", "post", "put", "delete"]])],
        [284, 285, 862],
        "Route handler with no visible permission check",
        "Guard the handler with an explicit permission check",
        "https://owasp.org/Top10/A01_2021-Broken_Access_Control/",
    ),
    Group(
        "A01-idor", "A01_Broken_Access_Control", "IDOR Vulnerability", "High",
        ["findById", "getById", "getUserById", "request.args.get('id')", "request.form['id']",
         "params.get('id')", "request.GET['id']"],
        [(r"(findById|getById|getUserById)\s*\(\s*request\.(args|form|GET)", False,
          [["findbyid", "getbyid", "getuserbyid"], ["request."]]),
         (r"(SELECT|DELETE|UPDATE).*WHERE.*id\s*=\s*['\"]?\$\{?[^}]*\}?['\"]?", False,
          [["select", "delete", "update"], ["where"], ["id"], ["$"]])],
        [639, 22],
        "Record fetched by an identifier the caller controls",
        "Check that the caller owns the record before returning it",
        "https://owasp.org/www-project-web-security-testing-guide/v42/4-Web_Application_Security_Testing/"
        "05-Authorization_Testing/04-Testing_for_Insecure_Direct_Object_References",
    ),
    Group(
        "A02-hash", "A02_Cryptographic_Failures", "Weak Hashing", "High",
        ["MD5", "SHA1", "md5", "sha1", "hashlib.md5", "hashlib.sha1",
         'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-1")'],
        [(r"(MD5|SHA-?1|md5|sha1)", False, [["md5", "sha1", "sha-1"]]),
         (r"MessageDigest\.getInstance\s*\(\s*['\"](MD5|SHA-?1)['\"]", False,
          [["messagedigest.getinstance"], ["md5", "sha1", "sha-1"]]),
         (r"hashlib\.(md5|sha1)", False, [["hashlib.md5", "hashlib.sha1"]])],
        [327, 328, 916],
        "Digest that is no longer collision resistant",
        "Move to SHA-256 or a newer digest",
        "https://owasp.org/Top10/A02_2021-Cryptographic_Failures/",
    ),
    Group(
        "A02-cipher", "A02_Cryptographic_Failures", "Weak Encryption", "High",
        ["DES", "3DES", "RC4", "ECB", 'Cipher.getInstance("DES', 'Cipher.getInstance("AES/ECB',
         "PyCrypto", "pycrypto"],
        [(r"Cipher\.getInstance\s*\(\s*['\"](DES|3DES|RC4|AES/ECB)", False, [["cipher.getinstance"]]),
         (r"(DES|3DES|RC4|ECB)(?!cription|crypt)", False, [["des", "rc4", "ecb"]]),
         (r"from\s+Crypto(?!graphy)", False, [["from"], ["crypto"]])],
        [327, 326, 328],
        "Cipher or block mode that can be broken",
        "Use AES-256 in an authenticated mode with a fresh nonce",
        "https://owasp.org/Top10/A02_2021-Cryptographic_Failures/",
    ),
    Group(
        "A03-sql", "A03_Injection", "SQL Injection", "Critical",
        ["Statement.executeQuery", "Statement.execute", "cursor.execute", 'query = "SELECT',
         "query = 'SELECT", 'sql = "INSERT', "sql = 'UPDATE"],
        [(r"(execute|executeQuery|executeBatch)\s*\(\s*['\"]\s*(SELECT|INSERT|UPDATE|DELETE).*['\"]\s*\+", True,
          [["execute"], _DML, ["+"]]),
         (r"(SELECT|INSERT|UPDATE|DELETE).*['\"]\s*\+\s*[a-zA-Z_][a-zA-Z0-9_]*", False, [_DML, ["+"]]),
         (r"cursor\.execute\s*\(\s*['\"f].*%[sd]", False, [["cursor.execute"], ["%s", "%d"]]),
         (r"(query|sql)\s*=\s*['\"f].*\{.*\}", False, [["query", "sql"], ["{"]])],
        [89, 564, 943],
        "SQL text assembled from parts that may be untrusted",
        "Bind values as statement parameters",
        "https://owasp.org/Top10/A03_2021-Injection/",
    ),
    Group(
        "A03-command", "A03_Injection", "Command Injection", "Critical",
        ["Runtime.getRuntime().exec", "ProcessBuilder", "subprocess.call", "subprocess.run",
         "subprocess.Popen", "os.system", "os.popen", "eval(", "exec("],
        [(r"(Runtime\.getRuntime\(\)\.exec|ProcessBuilder|subprocess\.(call|run|Popen)|os\.(system|popen))"
          r"\s*\([^)]*[+&|]", False,
          [["runtime.getruntime().exec", "processbuilder", "subprocess.", "os.system", "os.popen"]]),
         (r"(eval|exec)\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*", False, [["eval", "exec"]]),
         (r"shell\s*=\s*True", False, [["shell"]])],
        [78, 77, 94],
        "Process or code started from text that may be untrusted",
        "Pass a fixed program with an argument list and no shell",
        "https://owasp.org/Top10/A03_2021-Injection/",
    ),
    Group(
        "A04-controls", "A04_Insecure_Design", "Missing Security Controls", "Medium",
        ["TODO", "FIXME", "XXX", "HACK", "BUG", "password", "secret", "debug"],
        [(r"(TODO|FIXME|XXX|HACK|BUG).*security", False,
          [["todo", "fixme", "xxx", "hack", "bug"], ["security"]]),
         (r"(password|secret|key|token)\s*=\s*['\"]\w+['\"]\s*;?\s*#?\s*(TODO|FIXME)", False,
          [_SECRETS, ["todo", "fixme"]]),
         (r"debug\s*=\s*True", False, [["debug"]])],
        [656, 657, 693],
        "Sign of a safeguard that was left unfinished",
        "Finish the safeguard and drop leftover debugging code",
        "https://owasp.org/Top10/A04_2021-Insecure_Design/",
    ),
    Group(
        "A05-debug", "A05_Security_Misconfiguration", "Debug Configuration", "Medium",
        ["debug=True", "DEBUG=true", "printStackTrace", "console.log", "System.out.println", "print(", "echo "],
        [(r"(debug|DEBUG)\s*=\s*(True|true|1)", False, [["debug"]]),
         (r"printStackTrace\s*\(\s*\)", False, [["printstacktrace"]]),
         (r"(console\.log|System\.out\.println|print)\s*\([^)]*(?:password|secret|key|token)", False,
          [["console.log", "system.out.println", "print"], _SECRETS])],
        [489, 532, 215],
        "Diagnostic output or debug switch left on",
        "Switch diagnostics off outside development",
        "https://owasp.org/Top10/A05_2021-Security_Misconfiguration/",
    ),
    Group(
        "A06-versions", "A06_Vulnerable_Components", "Outdated Dependencies", "High",
        ["spring-core:4", "spring-web:4", "django==1", "flask==0", "requests==2.0", "jackson-databind:2.9",
         "struts2-core"],
        [(r"(spring-core|spring-web):[0-4]\.", False, [["spring-core:", "spring-web:"]]),
         (r"django==[01]\.", False, [["django=="]]),
         (r"flask==[0]\.", False, [["flask=="]]),
         (r"jackson-databind:2\.[0-9]\.", False, [["jackson-databind:2."]])],
        [1104, 1035, 937],
        "Dependency pinned to a release with known holes",
        "Raise the pinned version to a maintained release",
        "https://owasp.org/Top10/A06_2021-Vulnerable_and_Outdated_Components/",
    ),
    Group(
        "A07-login", "A07_Auth_Failures", "Weak Authentication", "High",
        ["password", "123456", "admin", "root", "guest", "hardcoded"],
        [(r"(password|passwd|pwd)\s*=\s*['\"](?![\$\{])(admin|root|123456?|password|pass|guest|test)['\"]", False,
          [["password", "passwd", "pwd"]]),
         (r"if\s+password\s*==\s*['\"][^'\"]{1,8}['\"]", False, [["password"]]),
         (r"(login|authenticate)\([^)]*['\"][^'\"]{1,8}['\"]", False, [["login(", "authenticate("]])],
        [798, 259, 521],
        "Credential that is guessable or stored in the text",
        "Keep credentials out of code and store only slow salted hashes",
        "https://owasp.org/Top10/A07_2021-Identification_and_Authentication_Failures/",
    ),
    Group(
        "A08-objects", "A08_Integrity_Failures", "Insecure Deserialization", "Critical",
        ["pickle.loads", "pickle.load", "yaml.load", "ObjectInputStream", "readObject", "Serializable",
         "eval(", "json.loads"],
        [(r"pickle\.(loads?|dump)\s*\([^)]*user_input", False, [["pickle."], ["user_input"]]),
         (r"yaml\.load\s*\([^)]*(?!Loader=yaml\.SafeLoader)", False, [["yaml.load"]]),
         (r"ObjectInputStream.*readObject\s*\(\)", False, [["objectinputstream"], ["readobject"]]),
         (r"eval\s*\(\s*json\.loads", False, [["eval"], ["json.loads"]])],
        [502, 494, 829],
        "Objects rebuilt from bytes that may be untrusted",
        "Decode with a loader that cannot create arbitrary objects",
        "https://owasp.org/Top10/A08_2021-Software_and_Data_Integrity_Failures/",
    ),
    Group(
        "A09-logging", "A09_Logging_Failures", "Missing Security Logging", "Medium",
        ["login", "authentication", "authorization", "admin", "privilege"],
        [(r"(login|authenticate|authorize)(?!.*log)", False, [["login", "authenticate", "authorize"]]),
         (r"@(Pre|Post)Authorize(?!.*audit)", False, [["@preauthorize", "@postauthorize"]]),
         (r"(failed|success).*login(?!.*log)", False, [["failed", "success"], ["login"]])],
        [778, 223, 532],
        "Security event that leaves no trace in a log",
        "Write an audit record for the event",
        "https://owasp.org/Top10/A09_2021-Security_Logging_and_Monitoring_Failures/",
    ),
    Group(
        "A10-ssrf", "A10_SSRF", "SSRF Vulnerability", "High",
        ["requests.get", "requests.post", "urllib.request", "HttpURLConnection", "RestTemplate", "WebClient",
         "fetch(", "axios.get"],
        [(r"(requests\.(get|post)|urllib\.request\.urlopen|HttpURLConnection)\s*\([^)]*[+&].*user_input", False,
          [["requests.get", "requests.post", "urllib.request.urlopen", "httpurlconnection"], ["user_input"]]),
         (r"(RestTemplate|WebClient|fetch|axios)\.[a-zA-Z]+\s*\(\s*[^)]*\+", False,
          [["resttemplate.", "webclient.", "fetch.", "axios."]]),
         (r"(http://|https://)[^'\"]*\{[^}]*\}", False, [["http"], ["{"]])],
        [918, 611, 441],
        "Outgoing request whose address may be untrusted",
        "Allow only known hosts for outgoing requests",
        "https://owasp.org/Top10/A10_2021-Server-Side_Request_Forgery_%28SSRF%29/",
    ),
]

# --- fixed values: Java expressions per finding type, and score per type --------------
JAVA_RULES = [
    ("SQLInjection", [
        (r"Statement\.execute\([^)]*\+", [["statement.execute("]]),
        (r"PreparedStatement\.setString\([^)]*\+", [["preparedstatement.setstring("]]),
        (r"createQuery\([^)]*\+", [["createquery("]]),
        (r"createNativeQuery\([^)]*\+", [["createnativequery("]]),
    ]),
    ("CommandInjection", [
        (r"Runtime\.getRuntime\(\)\.exec\(", [["runtime.getruntime().exec("]]),
        (r"ProcessBuilder\([^)]*\+", [["processbuilder("]]),
        (r"new\s+ProcessBuilder\([^)]*\+", [["new"], ["processbuilder("]]),
    ]),
    ("XSS", [
        (r"response\.getWriter\(\)\.write\([^)]*\+", [["response.getwriter().write("]]),
        (r"response\.getWriter\(\)\.print\([^)]*\+", [["response.getwriter().print("]]),
        (r"PrintWriter\.write\([^)]*\+", [["printwriter.write("]]),
    ]),
    ("PathTraversal", [
        (r"new\s+File\([^)]*\+", [["new"], ["file("]]),
        (r"Paths\.get\([^)]*\+", [["paths.get("]]),
        (r"Files\.newInputStream\([^)]*\+", [["files.newinputstream("]]),
    ]),
]
JAVA_SCORES = {"SQLInjection": 9, "CommandInjection": 8, "XSS": 7, "PathTraversal": 6}
DEFAULT_SCORE = 5
JAVA_METHOD = r"(public|private|protected)?\s*\w+\s+(\w+)\s*\("
JAVA_CLASS = r"class\s+(\w+)"
JAVA_KEYWORDS = ["new", "public", "private", "protected", "static", "final"]

# --- fixed values: Python syntax detectors --------------------------------------------
CODE_CALLS = ["eval", "exec", "compile"]
SHELL_CALLS = ["subprocess.call", "subprocess.run", "subprocess.Popen"]
OBJECT_MODULES = ["pickle", "cPickle", "dill"]
SECRET_NAMES = ["password", "secret", "key", "token", "api_key"]
SQL_CALLS = ["execute", "executemany"]
PY_SCORES = {
    "InsecureDesign": 3,
    "CodeInjection": 9,
    "CommandInjection": 8,
    "InsecureDeserialization": 6,
    "HardcodedCredentials": 7,
    "SQLInjection": 8,
}

# --- fixed values: opt-in extra Python rules (declared, unused by default) ------------
EXTRA_CALLS = ["eval", "exec", "compile", "__import__", "getattr", "setattr", "delattr", "hasattr",
               "globals", "locals", "vars", "open"]
EXTRA_SQL = [r"execute\s*\(", r"executemany\s*\(", r"raw\s*\(", r"extra\s*\(",
             r"SELECT.*FROM", r"INSERT.*INTO", r"UPDATE.*SET", r"DELETE.*FROM"]

# --- fixed values: category of a syntax finding, default A04 --------------------------
SYNTAX_CATEGORY = {
    "SQLInjection": "A03_Injection",
    "CommandInjection": "A03_Injection",
    "CodeInjection": "A03_Injection",
    "XSS": "A03_Injection",
    "HardcodedCredentials": "A07_Auth_Failures",
    "InsecureDeserialization": "A08_Integrity_Failures",
    "PathTraversal": "A01_Broken_Access_Control",
}

# --- fixed values: data flow name lists -----------------------------------------------
TAINT_SOURCES = ["request.args.get", "request.form.get", "request.json.get", "input(", "raw_input(",
                 "sys.argv", "os.environ", "request.GET", "request.POST", "request.FILES",
                 "HttpServletRequest.getParameter", "HttpServletRequest.getHeader"]
SANITIZERS = ["html.escape", "urllib.parse.quote", "escape", "bleach.clean", "validator.escape",
              "sanitize", "clean", "filter"]
SINKS = ["eval", "exec", "compile", "subprocess.call", "subprocess.run", "os.system", "os.popen",
         "Runtime.getRuntime().exec", "Statement.execute", "cursor.execute", "query"]

SYNTAX_TITLE = "Syntax check reported {0}"
SYNTAX_ADVICE = "Look at how {0} arises here"
FLOW_TITLE = "Untrusted value from %s reaches a %s sink"
FLOW_ADVICE = "Clean or validate the value before it reaches this call"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    ruleset: str  # basic, owasp, java, syntax
    category: str
    subcategory: str
    kind: str  # literal, regex, syntax
    pattern: str
    flags: str  # i, is, empty
    severity: str
    description: str
    remediation: str
    refs: tuple = ()
    cwe_ids: tuple = ()
    needs: tuple = ()
    impact: str = ""

    @property
    def dotall(self) -> bool:
        return "s" in self.flags


def line_advice(needle: str) -> str:
    return f"Check how '{needle}' is used here"


def _basic() -> list[Rule]:
    return [
        Rule(f"basic.{cat[:3]}.{i}", "basic", cat, "", "literal", needle, "i", sev,
             LINE_TITLES[cat], line_advice(needle))
        for cat, sev, needles in LINE_RULES
        for i, needle in enumerate(needles, 1)
    ]


def _owasp() -> list[Rule]:
    out = []
    for g in GROUPS:
        base = Rule("", "owasp", g.category, g.subcategory, "literal", "", "i", g.severity, g.title, g.advice,
                    (g.ref,), tuple(g.cwe_ids), impact=IMPACT[g.category])
        out += [replace(base, rule_id=f"{g.key}.lit{i}", pattern=p) for i, p in enumerate(g.literals, 1)]
        out += [
            replace(base, rule_id=f"{g.key}.rx{i}", kind="regex", pattern=p, flags="is" if dotall else "i",
                    needs=tuple(map(tuple, needs)))
            for i, (p, dotall, needs) in enumerate(g.regexes, 1)
        ]
    return out


def _severity_of_score(score: int) -> str:
    return "High" if score > 7 else "Medium"


def _detector(ruleset: str, rule_id: str, node_type: str, score: int, pattern: str = "", needs=()) -> Rule:
    return Rule(rule_id, ruleset, SYNTAX_CATEGORY.get(node_type, "A04_Insecure_Design"), node_type,
                "regex" if ruleset == "java" else "syntax", pattern, "i", _severity_of_score(score),
                SYNTAX_TITLE.format(node_type), SYNTAX_ADVICE.format(node_type),
                needs=tuple(map(tuple, needs)))


def _java() -> list[Rule]:
    return [
        _detector("java", f"java.{t}.{i}", t, JAVA_SCORES.get(t, DEFAULT_SCORE), p, needs)
        for t, regexes in JAVA_RULES
        for i, (p, needs) in enumerate(regexes, 1)
    ]


def _syntax() -> list[Rule]:
    return [_detector("syntax", f"syntax.{t}", t, s) for t, s in {**JAVA_SCORES, **PY_SCORES}.items()]


def rule_rows(*rulesets: str, extra: bool = False) -> list[Rule]:
    """All rules, or those of the named rule sets, in catalogue order."""
    rows = _basic() + _owasp() + _java() + _syntax()
    if extra or "py_extra" in rulesets:
        mk = lambda i, kind, p: Rule(
            f"extra.{kind}{i}", "py_extra", "A03_Injection", "Extra", kind, p, "i", "Medium",
            "Call or statement worth a look", "Confirm that the input is trusted")
        rows += [mk(i, "literal", p) for i, p in enumerate(EXTRA_CALLS, 1)]
        rows += [mk(i, "regex", p) for i, p in enumerate(EXTRA_SQL, 1)]
    return [r for r in rows if not rulesets or r.ruleset in rulesets]


def owasp_rules(category: str | None = None, kind: str | None = None) -> list[Rule]:
    """Content rules, optionally of one category (an unknown category gives none)."""
    return [r for r in rule_rows("owasp") if category in (None, r.category) and kind in (None, r.kind)]


def configure(rules: list[Rule], disabled: set[str] = frozenset(), severity: dict[str, str] | None = None) -> list[Rule]:
    """Settings per category: switched-off categories and severity overrides."""
    severity = severity or {}
    return [
        replace(r, severity=severity.get(r.category, r.severity)) for r in rules if r.category not in disabled
    ]


def rules_frame(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The catalogue as a DataFrame (below 200 rows, so always small enough to broadcast)."""
    rules = rule_rows() if rules is None else rules
    rows = [
        (r.rule_id, r.ruleset, r.category, r.subcategory, r.kind, r.pattern, r.flags, r.severity,
         SEVERITIES.index(r.severity) if r.severity in SEVERITIES else len(SEVERITIES),
         r.description, r.remediation, list(r.refs), list(r.cwe_ids), r.impact)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES)
