"""The rule catalogue as data, and its compilation to Catalyst expressions.

A signature rule looks for its patterns in the listed fields, in order; the first field that matches is reported. Rules
of a family become one array column, so that an event is tested on all rules in one projection, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions import net, text

P, Q, M, U, R = "uri_path", "uri_query", "original_message", "user_agent", "referrer"
PQM, ALL = (P, Q, M), (P, Q, U, R, M)
#: Java flags under which patterns mean what they do in Python: case, Unicode case and classes, line ends.
FLAGS = "(?iudU)"
#: Families whose rules only hold for requests that weren't refused.
SUCCESS_ONLY = ("injection", "cve_exploit")


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    family: str
    severity: str
    confidence: float
    description: str
    fields: tuple = ()
    patterns: tuple = ()


@dataclass(frozen=True)
class Sites:
    """What belongs to a site: its own domain, referrers that are no concern, and hosts that are local."""

    own_domain: str = "corp.example"
    trusted_suffixes: tuple = ()
    trusted_parts: tuple = ()
    local_hosts: tuple = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
    jwt_exclusion: str = ""


# Names, categories, severities, confidences, descriptions, fields and patterns of the signature rules.
RULES = [
    Rule("sql_injection", "sql_injection", "injection", "critical", 0.9, "SQL injection attempt detected", PQM, (
        r"(?:'|\%27)\s*(?:OR|AND)\s+\d+=\d+", r"(?:UNION\s+(?:ALL\s+)?SELECT)", r"(?:;\s*DROP\s+(?:TABLE|DATABASE))", r"(?:;\s*(?:DELETE|INSERT|UPDATE)\s+)",
        r"(?:extractvalue|updatexml)\s*\(", r"(?:LOAD_FILE|INTO\s+(?:OUT|DUMP)FILE)", r"(?:information_schema\.)", r"(?:CONCAT\s*\(.*SELECT)", r"(?:0x[0-9a-fA-F]{8,})", r"(?:/\*(?:.*?)\*/)")),
    Rule("blind_sql_injection", "blind_sql_injection", "injection", "critical", 0.92, "Blind SQL injection attempt detected", PQM, (
        r"(?:SLEEP|PG_SLEEP)\s*\(\s*\d+\s*\)", r"(?:WAITFOR\s+DELAY\s+'?\d{1,2}:\d{1,2}:\d{1,2}'?)", r"(?:BENCHMARK\s*\(\s*\d{3,}\s*,)",
        r"(?:IF\s*\(\s*(?:ASCII|SUBSTRING|MID|ORD|LENGTH)\s*\()", r"(?:CASE\s+WHEN\s+.+\s+THEN\s+SLEEP\s*\()", r"(?:AND|OR)\s+\(?\s*(?:SELECT|EXISTS\s*\()")),
    Rule("xss", "cross_site_scripting", "injection", "high", 0.9, "Cross-site scripting attempt", PQM, (
        r"<\s*script[^>]*>", r"javascript\s*:", r"(?:on(?:error|load|click|mouseover|focus|blur|submit|change))\s*=", r"alert\s*\(", r"eval\s*\(",
        r"document\.(?:cookie|write|location)", r"<\s*(?:img|svg|iframe|object|embed)\s+[^>]*(?:on\w+|src)\s*=", r"(?:fromCharCode|String\.fromCharCode)", r"(?:atob|btoa)\s*\(")),
    Rule("ssti", "server_side_template_injection", "injection", "critical", 0.85, "Server-side template injection attempt", PQM, (
        r"\{\{\s*\d+\s*\*\s*\d+\s*\}\}", r"\{\{\s*config\s*\}\}", r"\{%\s*import\s", r"\$\{\d+\s*\*\s*\d+\}", r"#\{.*\}", r"\{\{.*__class__.*\}\}", r"\{\{.*__mro__.*\}\}")),
    Rule("os_command_injection", "os_command_injection", "injection", "critical", 0.85, "OS command injection attempt", PQM, (
        r"((;\s*(whoami|id|uname|cat|ls|bash|sh|shell_exec))|&&|\||`|\$\(|invoke-webrequest|iex|downloadstring|wget|curl|webclient|powershell|\.exe).*powershell(?:\.exe)?", r"\bshell_exec\s*\(")),
    Rule("ldap_injection", "ldap_injection", "injection", "high", 0.8, "LDAP injection attempt", (P, Q), (r"\)\s*\(\s*\|", r"\*\)\s*\(", r"\|\s*\(\s*&\s*\(")),
    Rule("xpath_injection", "xpath_injection", "injection", "high", 0.8, "XPath injection attempt", (P, Q), (r"'\s*or\s+'1'\s*=\s*'1", r"string\s*\(\s*//", r"count\s*\(\s*//")),
    Rule("xxe", "xml_external_entity", "injection", "critical", 0.9, "XML External Entity injection", PQM, (r"<!ENTITY", r"<!DOCTYPE[^>]*SYSTEM", r"SYSTEM\s+[\"'](?:file|http|ftp|php|expect)://")),
    Rule("http_param_pollution", "http_parameter_pollution", "injection", "medium", 0.6, "HTTP parameter pollution", (P, Q), (r"(?:\?|&)(\w+)=.*?&\1=",)),
    Rule("insecure_deserialization", "insecure_deserialization", "injection", "critical", 0.85, "Insecure deserialization markers", PQM, (
        r"rO0AB", r"aced0005", r"O:\d+:\"", r"__reduce__", r"pickle\.loads", r"java\.lang\.Runtime")),
    Rule("ssrf", "server_side_request_forgery", "injection", "high", 0.85, "Server-side request forgery attempt", PQM, (
        r"(?:url|uri|path|file|src|href|redirect|proxy|fetch)\s*=\s*(?:https?://)?(?:127\.0\.0\.1|localhost|0\.0\.0\.0)", r"(?:url|uri|path|file|src)\s*=\s*(?:https?://)?169\.254\.169\.254",
        r"(?:url|uri|path|file|src)\s*=\s*file:///", r"/latest/meta-data", r"/computeMetadata/v1")),
    Rule("prototype_pollution", "prototype_pollution", "injection", "high", 0.8, "Prototype pollution attempt", (P, Q), (r"__proto__", r"constructor\.prototype")),
    Rule("expression_language_injection", "expression_language_injection", "injection", "critical", 0.95, "Expression Language / JNDI injection (includes Log4Shell)", ALL, (
        r"\$\{jndi:(?:ldap|rmi|dns|iiop|corba|nds|http)s?://", r"\$\{env:", r"\$\{sys:", r"\$\{java:", r"T\(java\.lang\.Runtime\)", r"\$\{\$\{")),
    Rule("session_fixation", "session_fixation", "auth_access", "high", 0.8, "Session fixation attempt - session IDs in URL", (P, Q), (
        r"(([?&;])(JSESSIONID|PHPSESSID|sessionid|sessid|sid|ASPSESSIONID)=[a-z0-9\-]{8,}|;jsessionid=[a-z0-9\-]{8,})",)),
    Rule("idor", "idor", "auth_access", "medium", 0.6, "IDOR: sequential ID enumeration in API paths", (P,), (r"/api/(?:v\d+/)?(?:users?|accounts?|profiles?|orders?|invoices?)/\d{1,8}(?:/|$)",)),
    Rule("privilege_escalation_probe", "privilege_escalation", "auth_access", "critical", 0.85, "Privilege escalation attempt via shell commands, SUID bits, or known tooling", PQM, (
        r"((;\s*|\|\||&&|\|)\s*(sudo|su|chmod|chown|setcap))\b|(cmd=|exec=|system=).*(sudo|su|chmod|chown)\b|chmod\s+[0-7]*4[0-7]{2}|\bsu\s+-?\s*root\b|bash\s+-p|sh\s+-p|python.*pty\.spawn|/etc/(sudoers|shadow)|setcap\s+|(?:\s*\./|\s*/tmp/|\s*/dev/shm/).*(linpeas|pspy|linenum)",)),
    Rule("sensitive_file_exposure", "sensitive_information_disclosure", "info_leakage", "critical", 0.9, "Access to sensitive config/credential files", (P,), (
        r"(?:/\.env|/\.env\.local|/\.env\.prod)", r"/wp-config\.php", r"/config\.yml|/config\.yaml|/config\.json", r"/application\.properties|/application\.yml", r"/\.htpasswd|/\.htaccess", r"/web\.config")),
    Rule("backup_file_hunting", "sensitive_information_disclosure", "info_leakage", "high", 0.75, "Probing for backup/archive files", (P,), (
        r"\.(?:bak|old|orig|copy|save|swp|tmp|temp)(?:\?|$)", r"\.(?:sql|dump|tar|gz|zip|rar|7z)(?:\?|$)", r"~$")),
    Rule("source_code_exposure", "sensitive_information_disclosure", "info_leakage", "critical", 0.9, "Access to source code repo files", (P,), (
        r"/\.git/(?:HEAD|config|index|objects|refs)", r"/\.svn/(?:entries|wc\.db)", r"/\.hg/", r"/\.DS_Store", r"/\.idea/")),
    Rule("debug_endpoint_exposure", "sensitive_information_disclosure", "info_leakage", "high", 0.8, "Access to debug/admin endpoints", (P,), (
        r"/(?:debug|_debug|trace|_trace)\b", r"/actuator(?:/|$)", r"/console(?:/|$)", r"/phpinfo(?:\.php)?", r"/server-(?:status|info)", r"/_profiler")),
    Rule("technology_fingerprinting", "recon_scanner", "info_leakage", "medium", 0.65, "Technology stack fingerprinting probes", (P,), (
        r"/wp-(?:admin|login|includes|content|cron)", r"/joomla|/administrator", r"/drupal|/sites/default", r"/phpmyadmin|/pma|/adminer", r"/solr(?:/|$)", r"/jenkins(?:/|$)", r"/grafana(?:/|$)", r"/kibana(?:/|$)")),
    Rule("api_schema_discovery", "recon_scanner", "info_leakage", "medium", 0.7, "API documentation/schema discovery", (P,), (
        r"/swagger(?:-ui|-resources)?(?:/|$|\.)", r"/api-docs(?:/|$)", r"/openapi\.(?:json|yaml)", r"/graphql/schema", r"/\.well-known/")),
    Rule("hardcoded_creds_url", "hardcoded_credential_exposure", "info_leakage", "high", 0.85, "Credentials/secrets in URL query string", PQM, (
        r"[?&](?:password|passwd|pwd|secret|api_key|apikey|access_token|auth_token|private_key)\s*=\s*[^&\s]{3,}",)),
    Rule("hardcoded_secret_pattern", "hardcoded_credential_exposure", "info_leakage", "high", 0.88, "Known credential/token patterns observed in request data", PQM, (
        r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{36}", r"AIza[0-9A-Za-z\-_]{35}", r"xox[baprs]-[A-Za-z0-9-]{10,48}", r"-----BEGIN\s+(?:RSA|EC|OPENSSH|DSA)\s+PRIVATE\s+KEY-----")),
    Rule("path_traversal", "path_traversal", "path_file", "high", 0.9, "Path traversal attempt", PQM, (r"\.\./", r"\.\.\\", r"\.\.%2[fF]", r"\.\.%255[cC]", r"%2[eE]%2[eE]%2[fF]", r"\.\.%c0%af")),
    Rule("local_file_inclusion", "local_file_inclusion", "path_file", "critical", 0.9, "Local file inclusion attempt", PQM, (
        r"/etc/passwd", r"/etc/shadow", r"/proc/self/(?:environ|cmdline|fd|maps)", r"/windows/system32", r"/boot\.ini",
        r"(?:file|page|include|path|doc|template)\s*=\s*(?:\.\./|/(?:etc/passwd|etc/shadow|proc/self/environ|proc/version|win\.ini|boot\.ini|web\.config|wp-config\.php|application\.yml|\.env))")),
    Rule("remote_file_inclusion", "rfi", "path_file", "critical", 0.85, "Remote file inclusion attempt", (P, Q), (
        r"(?:file|page|include|path|url)\s*=\s*https?://", r"(?:file|page|include)\s*=\s*ftp://", r"(?:file|page|include)\s*=\s*php://")),
    Rule("webshell_access", "remote_code_execution", "path_file", "critical", 0.9, "Access to known webshell paths", (P,), (
        r"/(?:cmd|shell|c99|r57|wso|b374k|alfa|mini)\.(?:php|asp|aspx|jsp|cgi)", r"/(?:uploads?|tmp|temp|cache|images?)/[^/]*\.(?:php|asp|aspx|jsp)\b", r"[?&]cmd=", r"[?&]exec=")),
    Rule("arbitrary_file_read", "arbitrary_file_read", "path_file", "high", 0.75, "Arbitrary file read via parameter manipulation", (P, Q), (
        r"(?:download|read|view|get|fetch|open|load)\s*[?&=]\s*(?:\.\./|/)", r"[?&](?:filename|filepath|path|file|name|doc)\s*=\s*(?:\.\./|/(?:etc|var|tmp|proc))")),
    Rule("cache_deception", "cache_deception", "cache_redirect", "medium", 0.6, "Cache deception attempt", (P,), (
        r"/account.*\.(?:css|js|jpg|png|gif|ico)", r"/profile.*\.(?:css|js|jpg|png|gif|ico)", r"/admin.*\.(?:css|js|jpg|png|gif|ico)")),
    Rule("cache_poisoning", "cache_poisoning", "cache_redirect", "medium", 0.5, "Cache poisoning probe", (M,), (r"X-Forwarded-Host\s*:", r"X-Original-URL\s*:", r"X-Rewrite-URL\s*:")),
    Rule("known_scanner_ua", "recon_scanner", "bot_scanner", "high", 0.95, "Known vulnerability scanner user agent", (U,), (
        r"(?:sqlmap|nikto|nmap|nessus|openvas|masscan|zap(?:proxy)?|skipfish|w3af|arachni)", r"(?:burp(?:suite)?|qualys|acunetix|appscan|webinspect|netsparker|invicti)",
        r"(?:dirbuster|dirb|gobuster|wfuzz|ffuf|feroxbuster)", r"(?:nuclei|subfinder|amass|httpx|dalfox|tplmap|commix|hydra)", r"(?:masscan|zgrab|censys|shodan)")),
    Rule("headless_browser", "bot_automation", "bot_scanner", "medium", 0.6, "Headless browser or automation tool", (U,), (
        r"\bHeadlessChrome\/\d+(?:\.\d+){1,3}\b.*\b(curl|wget|python|libwww|java|requests)\b|(?:^|\s)HeadlessChrome\/\d+(?:\.\d+){1,3}\b(?:\s*$)",
        r"PhantomJS", r"(?:Selenium|webdriver|Playwright)", r"Puppeteer", r"(?:Cypress|Nightwatch|Robot Framework)")),
    Rule("fake_search_bot", "bot_automation", "bot_scanner", "medium", 0.6, "Fake search engine bot", (U,), (r"(?:Googlebot|Bingbot|baiduspider|YandexBot)(?!/)",)),
    Rule("malicious_bot_signature", "bot_automation", "bot_scanner", "high", 0.85, "Known malicious bot signature", (U,), (
        r"(?:Morfeus|ZmEu|Muieblackcat|AutoPwn)", r"(?:DirBuster|Gobuster|Dirsearch)", r"(?:WhatWeb|BlindElephant)")),
    Rule("rate_limiting_bypass_headers", "rate_limiting_bypass", "rate_dos", "high", 0.8, "Rate limiting bypass probe via spoofed client identity headers", PQM, (
        r"(?:X-Forwarded-For|X-Real-IP|X-Client-IP|True-Client-IP|CF-Connecting-IP)\s*:", r"(?:Forwarded)\s*:\s*for=", r"[?&](?:x_forwarded_for|x_real_ip|client_ip|forwarded|true_client_ip)\s*=")),
    Rule("log4shell_cve_2021_44228", "cve_exploit", "cve_exploit", "critical", 0.95, "Log4Shell (CVE-2021-44228) JNDI injection", ALL, (r"\$\{jndi:(?:ldap|rmi|dns|iiop|corba|nds|http)s?://",)),
    Rule("spring4shell_cve_2022_22965", "cve_exploit", "cve_exploit", "critical", 0.9, "Spring4Shell (CVE-2022-22965)", PQM, (r"class\.module\.classLoader", r"class%5B%5D")),
    Rule("shellshock_cve_2014_6271", "cve_exploit", "cve_exploit", "critical", 0.95, "Shellshock (CVE-2014-6271)", (U, R, M), (r"\(\)\s*\{.*;\s*\}\s*;",)),
    Rule("apache_struts_rce", "cve_exploit", "cve_exploit", "critical", 0.9, "Apache Struts OGNL injection / RCE", PQM, (r"%\{.*#_memberAccess", r"ognl\.OgnlContext")),
    Rule("php_specific_attack", "cve_exploit", "cve_exploit", "high", 0.85, "PHP-specific attack patterns", PQM, (
        r"php://(?:input|filter|data|expect)", r"/cgi-bin/.*\.(?:cgi|pl|py|sh)", r"<\?php", r"assert\s*\(", r"base64_decode\s*\(", r"system\s*\(", r"passthru\s*\(")),
]
CODED = [
    Rule("jwt_manipulation", "jwt_manipulation", "auth_access", "high", 0.75, "JWT token manipulation attempt", PQM),
    Rule("csrf_indicator", "csrf", "auth_access", "medium", 0.5, "CSRF indicator: state-changing request with suspicious referer and missing token"),
    Rule("broken_function_auth", "broken_function_level_auth", "auth_access", "high", 0.6, "Successful access to admin/management endpoints"),
    Rule("error_detail_disclosure", "sensitive_information_disclosure", "info_leakage", "medium", 0.5, "Large 5xx response possibly containing error details"),
    Rule("data_exfiltration_pattern", "sensitive_information_disclosure", "info_leakage", "high", 0.5, "Large data response from sensitive endpoints"),
    Rule("open_redirect", "open_redirect", "cache_redirect", "medium", 0.8, "Open redirect via URL parameter"),
]
RATES = [
    Rule("brute_force_login", "broken_authentication", "auth_access", "high", 0.85, "Brute force login: >10 auth failures from same IP in batch"),
    Rule("credential_stuffing", "broken_authentication", "auth_access", "high", 0.8, "Credential stuffing: many distinct login attempts from same IP"),
    Rule("authentication_failures", "authentication_failures", "auth_access", "medium", 0.75, "Repeated authentication failures from same source"),
    Rule("rapid_404_generation", "recon_scanner", "bot_scanner", "high", 0.8, "Rapid 404 generation (directory brute-forcing)"),
    Rule("content_scraping", "bot_automation", "bot_scanner", "medium", 0.5, "Systematic content scraping"),
    Rule("http_flood", "rate_limiting", "rate_dos", "critical", 0.9, "HTTP flood: extremely high request rate"),
    Rule("rate_limiting_bypass_after_429", "rate_limiting_bypass", "rate_dos", "high", 0.75, "Sustained request bursts despite repeated HTTP 429 throttling"),
    Rule("slowloris_suspected", "denial_of_service", "rate_dos", "high", 0.7, "Slowloris attack suspected: multi-factor scoring"),
    Rule("api_rate_abuse", "rate_limiting", "rate_dos", "high", 0.7, "API rate abuse"),
    Rule("resource_exhaustion", "denial_of_service", "rate_dos", "medium", 0.5, "Repeated hits to expensive endpoints"),
]
ADMIN_PATHS = ["/admin", "/manager", "/management", "/console", "/dashboard/admin", "/api/admin", "/superadmin", "/wp-admin/admin-ajax"]
EXPORT_PATHS = ["/export", "/download", "/dump", "/backup", "/api/users", "/api/data"]
LOGIN_PATHS = ["/login", "/signin", "/auth", "/api/auth", "/wp-login", "/admin/login", "/j_security_check", "/oauth/token"]
AUTH_HINTS = ["/login", "/signin", "/auth", "/oauth", "/session", "/token", "/password"]
EXPENSIVE = r"^/(search|export|report|download|generate|process)(/|$)"
REDIRECTS = r"(?:^|[?&])(?:redirect|url|next|return|goto|continue|dest|destination|redir|returnUrl|target|forward)\s*=\s*([^&\s]+)"
TOKENS = r"(token|auth|state|session)="
JWT = r"(eyJ[^.]*ImFsZyI6Im5vbmUifQ|\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.\b|(GET|POST).*?(token=|jwt=|auth=).*?eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)"
# End of the fixed values.

#: Literals of which a field that matches must hold one, in lower case; they spare most expressions on ASCII text.
TRIGGERS = {
    "sql_injection": ["%27", "'", "union", "drop", ";", "extractvalue", "updatexml", "load_file", "into", "information_schema", "concat", "0x", "/*"],
    "blind_sql_injection": ["(", "waitfor", "select"],
    "xss": ["<", "javascript", "onerror", "onload", "onclick", "onmouseover", "onfocus", "onblur", "onsubmit", "onchange", "alert", "eval", "document.", "fromcharcode", "atob", "btoa"],
    "ssti": ["{{", "{%", "${", "#{"],
    "os_command_injection": ["powershell", "shell_exec"],
    "ldap_injection": ["("],
    "xpath_injection": ["'", "//"],
    "xxe": ["<!entity", "<!doctype", "system"],
    "http_param_pollution": ["&"],
    "insecure_deserialization": ["ro0ab", "aced0005", "o:", "__reduce__", "pickle.loads", "java.lang.runtime"],
    "ssrf": ["127.0.0.1", "localhost", "0.0.0.0", "169.254.169.254", "file:///", "/latest/meta-data", "/computemetadata/v1"],
    "prototype_pollution": ["__proto__", "constructor.prototype"],
    "expression_language_injection": ["${", "t(java.lang.runtime)"],
    "session_fixation": ["sid=", "sessionid="],
    "idor": ["/api/"],
    "privilege_escalation_probe": ["su", "chmod", "chown", "setcap", "-p", "pty.spawn", "/etc/shadow", "linpeas", "pspy", "linenum"],
    "sensitive_file_exposure": ["/.env", "/wp-config.php", "/config.", "/application.", "/.ht", "/web.config"],
    "backup_file_hunting": [".bak", ".old", ".orig", ".copy", ".save", ".swp", ".tmp", ".temp", ".sql", ".dump", ".tar", ".gz", ".zip", ".rar", ".7z", "~"],
    "source_code_exposure": ["/.git/", "/.svn/", "/.hg/", "/.ds_store", "/.idea/"],
    "debug_endpoint_exposure": ["debug", "trace", "/actuator", "/console", "/phpinfo", "/server-", "/_profiler"],
    "technology_fingerprinting": ["/wp-", "/joomla", "/administrator", "/drupal", "/sites/default", "/phpmyadmin", "/pma", "/adminer", "/solr", "/jenkins", "/grafana", "/kibana"],
    "api_schema_discovery": ["/swagger", "/api-docs", "/openapi.", "/graphql/schema", "/.well-known/"],
    "hardcoded_creds_url": ["password", "passwd", "pwd", "secret", "api_key", "apikey", "_token", "private_key"],
    "hardcoded_secret_pattern": ["akia", "asia", "ghp_", "aiza", "xox", "-----begin"],
    "path_traversal": ["../", "..\\", "..%", "%2e"],
    "local_file_inclusion": ["/etc/", "/proc/", "/windows/system32", "/boot.ini", "../", "/win.ini", "/web.config", "/wp-config.php", "/application.yml", "/.env"],
    "remote_file_inclusion": ["://"],
    "webshell_access": [".php", ".asp", ".jsp", ".cgi", "cmd=", "exec="],
    "arbitrary_file_read": ["=", "?", "&"],
    "cache_deception": ["/account", "/profile", "/admin"],
    "cache_poisoning": ["x-forwarded-host", "x-original-url", "x-rewrite-url"],
    "headless_browser": ["headlesschrome", "phantomjs", "selenium", "webdriver", "playwright", "puppeteer", "cypress", "nightwatch", "robot framework"],
    "fake_search_bot": ["googlebot", "bingbot", "baiduspider", "yandexbot"],
    "rate_limiting_bypass_headers": ["x-", "true-client-ip", "cf-connecting-ip", "forwarded", "x_", "client_ip"],
    "log4shell_cve_2021_44228": ["${jndi:"],
    "spring4shell_cve_2022_22965": ["class.module.classloader", "class%5b%5d"],
    "shellshock_cve_2014_6271": ["()"],
    "apache_struts_rce": ["%{", "ognl.ognlcontext"],
    "php_specific_attack": ["php", "cgi-bin", "assert", "base64_decode", "system", "passthru"],
}
#: The same for the token rule and the redirects.
JWT_TRIGGER = ["eyj"]
REDIRECT_TRIGGERS = ["url", "redir", "next", "return", "goto", "continue", "dest", "target", "forward"]
EVERY = {r.name: r for r in [*RULES, *CODED, *RATES]}
FAMILIES = list(dict.fromkeys(r.family for r in RULES))


def _hit(rule: Rule, field: Column | str, evidence: Column) -> Column:
    return F.struct(F.lit(rule.name).alias("rule_name"), (F.lit(field) if isinstance(field, str) else field).alias("matched_field"), F.substring(evidence, 1, 200).alias("evidence"))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _joined(fields: tuple) -> str:
    """The column that holds these fields' texts in lower case, on lines of their own."""
    return "_low_" + "_".join(fields)


def signature(rule: Rule) -> Column:
    """A struct for the first field that matches, or null. Expects the columns that matches() adds.

    Given as one SQL text: composed of columns, the catalogue takes thousands of calls to the JVM for each query. Literals
    are looked for once in all fields together, and only on ASCII text; there the plain flags mean the same and are faster.
    """
    pattern = "|".join(f"(?:{p})" for p in rule.patterns)
    cases = []
    for f in rule.fields:
        holds = f"CASE WHEN _ascii THEN {f} RLIKE {_quoted('(?id)' + pattern)} ELSE {f} RLIKE {_quoted(FLAGS + pattern)} END"
        cases.append(f"WHEN {f} <> '' AND {holds} THEN named_struct('rule_name', {_quoted(rule.name)}, 'matched_field', '{f}', 'evidence', substring({f}, 1, 200))")
    hit, gates = f"CASE {' '.join(cases)} END", []
    if rule.family in SUCCESS_ONLY:
        gates.append("_not_refused")
    if rule.name in TRIGGERS:
        gates.append(f"(NOT _ascii OR {' OR '.join(f'contains({_joined(rule.fields)}, {_quoted(t)})' for t in TRIGGERS[rule.name])})")
    return F.expr(f"CASE WHEN {' AND '.join(gates)} THEN {hit} END" if gates else hit)


def _any(column: Column, parts: list[str], how: str = "contains") -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | getattr(column, how)(p)
    return F.coalesce(out, F.lit(False))


def _gated(pattern: str, triggers: list[str], field: Column, apply) -> Column:
    """apply(pattern with its flags), null for ASCII text without any of the literals that the pattern needs; expects `_ascii`."""
    low = F.lower(field)
    holds = _any(low, triggers)
    return F.when(F.col("_ascii"), F.when(holds, apply("(?id)" + pattern))).otherwise(apply(FLAGS + pattern))


def coded(sites: Sites = Sites(), fixed: bool = True) -> dict[str, Column]:
    """The predicates that aren't patterns, by rule. With fixed=False the token rule never fires, as published."""
    rules = {r.name: r for r in CODED}
    path, surface = F.lower(F.coalesce(F.col(P), F.lit(""))), F.col("_surface")
    size = F.coalesce(F.nullif(F.col("response_size"), F.lit(0)), F.col("bytes_sent"), F.lit(0))
    everything = F.concat_ws(" ", P, Q, M)
    excluded = everything.contains(sites.jwt_exclusion) if sites.jwt_exclusion else F.lit(False)
    token = F.coalesce(*(F.when(_gated(JWT, JWT_TRIGGER, F.col(f), lambda p, f=f: F.col(f).rlike(p)), _hit(rules["jwt_manipulation"], f, F.col(f))) for f in PQM))
    host = F.col("_referrer_host")
    own = (host == sites.own_domain) | host.endswith("." + sites.own_domain)
    trusted = _any(host, list(sites.trusted_suffixes), "endswith") | _any(host, list(sites.trusted_parts))
    csrf = F.col("http_method").isin("POST", "PUT", "DELETE", "PATCH") & F.col(R).startswith("http") & host.isNotNull() & ~own & ~trusted & ~surface.rlike("(?i)" + TOKENS)
    target, plain, there, number = F.col("_target"), F.col("_plain"), F.col("_there"), F.col("_there_number")
    private = net.in_networks(number, net.PRIVATE) & ~net.in_networks(number, net.PUBLIC_WITHIN_PRIVATE)
    away = plain.startswith("//") | (plain.rlike("^https?://") & there.isNotNull() & ~there.isin(*sites.local_hosts) & ~private)
    return {
        "jwt_manipulation": F.when(~excluded, token) if fixed else F.when(F.lit(False), token),
        "csrf_indicator": F.when(csrf, _hit(rules["csrf_indicator"], R, F.concat(F.col("http_method"), F.lit(" cross-origin from "), F.substring(R, 1, 100), F.lit(" with missing token")))),
        "broken_function_auth": F.when(F.col("http_status").between(200, 299) & _any(path, ADMIN_PATHS, "startswith"), _hit(rules["broken_function_auth"], P, F.concat(F.lit("200 OK on admin path: "), F.substring(path, 1, 100)))),
        "error_detail_disclosure": F.when((F.col("http_status") >= 500) & (size > 5000), _hit(rules["error_detail_disclosure"], "http_status", F.concat(F.lit("HTTP "), F.col("http_status"), F.lit(" with "), size, F.lit("B response")))),
        "data_exfiltration_pattern": F.when((size > 100000) & _any(path, EXPORT_PATHS), _hit(rules["data_exfiltration_pattern"], P, F.concat(F.lit("Large response ("), size, F.lit("B) from "), F.substring(path, 1, 80)))),
        "open_redirect": F.when((target != "") & away, _hit(rules["open_redirect"], Q, F.concat(F.lit("Open redirect to external target: "), F.substring(target, 1, 100)))),
    }


def prepared(events: DataFrame) -> DataFrame:
    """Adds what the predicates use more than once, each in its own projection, so that it is computed once."""
    surface = F.concat_ws(" ", F.nullif(F.col(Q), F.lit("")), F.nullif(F.col(M), F.lit("")))
    everything = F.concat_ws("", *ALL)
    ascii_only = F.octet_length(everything) == F.char_length(everything)
    out = events.withColumns({"_surface": surface, "_ascii": ascii_only, "_referrer_host": F.when(F.col(R).startswith("http"), text.host(F.col(R)))})
    out = out.withColumn("_target", F.coalesce(_gated(REDIRECTS, REDIRECT_TRIGGERS, F.col("_surface"), lambda p: F.regexp_extract("_surface", p, 1)), F.lit("")))
    out = out.withColumn("_plain", F.when(F.col("_target") != "", F.trim(text.unquote(F.col("_target")))))
    out = out.withColumn("_there", text.host(F.col("_plain")))
    return out.withColumn("_there_number", F.when(F.col("_there").isNotNull(), net.ip_number(F.col("_there"))))


#: A request is what the rules of PER_EVENT don't look beyond. It is frequent if it comes so often, and is at least such a
#: share of all events (so that there are at most so many), and if its texts together are no longer than that.
REQUEST, PER_EVENT = (*ALL, "http_method", "_not_refused"), ("broken_function_auth", "error_detail_disclosure", "data_exfiltration_pattern")
REPEATED, FREQUENT, LENGTH = 16, 10_000, 2_000


def _ready(events: DataFrame, chosen: list[Rule]) -> DataFrame:
    joined = {fields: F.lower(F.concat_ws("\n", *fields)) for fields in dict.fromkeys(r.fields for r in chosen)}
    return prepared(events).withColumns({_joined(k): v for k, v in joined.items()})


def frequent(events: DataFrame, hits: Column, chosen: list[Rule] = RULES) -> DataFrame:
    """(_h, REQUEST, _known): the frequent requests of events and their hits, each request tested once."""
    # one number for both uses, so that Spark sums once; long requests count as never seen
    counts = events.groupBy(*REQUEST).agg(F.count_if(F.length(F.concat_ws("", *ALL)) <= LENGTH).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    often = counts.where(F.col("n") >= REPEATED).join(F.broadcast(total), F.col("n") * FREQUENT >= F.col("total"))
    # a generator, as in matches(): in a projection the method is too large for the JIT compiler
    return _ready(often.select(*REQUEST), chosen).select(F.xxhash64(*REQUEST).alias("_h"), *REQUEST, F.explode(F.array(hits)).alias("_known"))


def matches(events: DataFrame, families: list[str] | None = None, sites: Sites = Sites(), fixed: bool = True, keys: tuple = (), repeated: bool = False) -> DataFrame:
    """One row for each event and rule that holds: the event's keys, rule_name, matched_field and evidence.

    With `repeated`, frequent requests are tested once and their hits are joined (broadcast); all other requests are
    tested where they are. In a stream all are.
    """
    extra = coded(sites, fixed)
    chosen = [r for r in RULES if r.family in (families or FAMILIES)]
    some = [r for r in CODED if r.family in (families or FAMILIES)]
    of_request = [*map(signature, chosen), *(extra[r.name] for r in some if r.name not in PER_EVENT)]
    of_event = [extra[r.name] for r in some if r.name in PER_EVENT]
    events = events.withColumn("_not_refused", F.col("http_status").isNull() | F.col("http_status").between(200, 399))
    if repeated and not events.isStreaming:
        known = frequent(events, F.array_compact(F.array(*of_request)), chosen).toDF("_h", *(f"_of_{c}" for c in REQUEST), "_known")
        same = F.xxhash64(*REQUEST) == F.col("_h")
        for c in REQUEST:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        events = events.join(F.broadcast(known), same, "left")
        # what is known needs no texts beyond the rules that look at the event itself
        events = events.withColumn("_own", F.array_compact(F.array(*of_event))).withColumns({c: F.when(F.col("_known").isNull(), F.col(c)) for c in ALL})
        hits = F.concat("_own", F.coalesce("_known", F.array_compact(F.array(*of_request))))
    else:
        hits = F.array_compact(F.array(*of_request, *of_event))
    # without rules that don't hold; an event without any gives a row of nulls, which goes. The outer form keeps Spark from
    # asking first whether there are any, which would evaluate all rules once more
    return _ready(events, chosen).select(*keys, "row_number", "event_id", "event_ts", "src_ip", F.inline_outer(hits)).where("rule_name is not null")


def rate_matches(events: DataFrame, keys: tuple = ()) -> DataFrame:
    """One row for each source and rate rule that holds: its last counted event and the counts as evidence.

    Sources are summed up by path first, so a source with most of the rows is dealt over its paths and tasks.
    """
    path, status = F.lower(F.coalesce(F.col(P), F.lit(""))), F.col("http_status")
    event = F.struct("row_number", "event_id", "event_ts", P)
    classes = {
        "all": F.lit(True),
        "login": (status == 401) | ((status == 403) & _any(path, LOGIN_PATHS)),
        "s401": status == 401,
        "auth": status.isin(401, 403) & (_any(path, AUTH_HINTS) | text.filled(F.col("username"))),
        "s404": status == 404,
        "s200": status == 200,
        "ok": status.between(200, 299),
        "s429": status == 429,
        "other": (status != 429) & (status != 0),
        "costly": path.rlike(EXPENSIVE),
    }
    by_path = events.where(text.filled(F.col("src_ip"))).groupBy(*keys, "src_ip", P).agg(
        *(F.count_if(c).alias(f"n_{k}") for k, c in classes.items()), *(F.max(F.when(c, event)).alias(f"last_{k}") for k, c in classes.items())
    )
    named = text.filled(F.col(P))
    api = by_path.where(F.lower(P).contains("/api/")).groupBy(*keys, "src_ip", F.lower(P).alias("api")).agg(F.sum("n_all").alias("n"), F.max("last_all").alias("last"), F.min("last_all.row_number").alias("at"))
    api = api.where("n >= 300").groupBy(*keys, "src_ip").agg(F.min_by(F.struct("api", "n", "last"), F.struct("at", "api")).alias("api"))
    by_source = by_path.groupBy(*keys, "src_ip").agg(
        *(F.sum(f"n_{k}").alias(f"n_{k}") for k in classes), *(F.max(f"last_{k}").alias(f"last_{k}") for k in classes),
        F.count_if(named).alias("paths"), F.count_if(named & (F.col("n_s404") > 0)).alias("paths_404"), F.count_if(named & (F.col("n_ok") > 0)).alias("paths_ok"),
    ).join(api, [*keys, "src_ip"], "left")
    ip, n = F.col("src_ip"), lambda k: F.col(f"n_{k}")
    outside = ~net.is_private(ip)

    def found(name: str, when: Column, last: Column, field: str, uri: bool, *parts) -> Column:
        evidence = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
        return F.when(when, F.struct(F.lit(name).alias("rule_name"), F.lit(field).alias("matched_field"), evidence.alias("evidence"), last["row_number"].alias("row_number"), last["event_id"].alias("event_id"), last["event_ts"].alias("event_ts"), (last[P] if uri else F.lit(None).cast("string")).alias("uri")))

    last = lambda k: F.col(f"last_{k}")
    shown = lambda k: F.coalesce(last(k)[P], F.lit("None"))
    rules = [
        found("brute_force_login", n("login") >= 10, last("login"), "http_status", False, n("login"), " auth failures from ", ip),
        found("credential_stuffing", n("s401") >= 20, last("s401"), "http_status", False, n("s401"), " 401 responses from ", ip),
        found("authentication_failures", n("auth") >= 8, last("auth"), "http_status", False, n("auth"), " authentication failures from ", ip),
        found("rapid_404_generation", outside & (n("s200") <= 1) & (F.col("paths_404") >= 50), last("s404"), "http_status", True, F.col("paths_404"), " unique 404s from ", ip, " on ", shown("s404"), " (successes: ", n("s200"), ")"),
        found("content_scraping", outside & (F.col("paths_ok") >= 200), last("ok"), "uri_path", True, F.col("paths_ok"), " unique URIs from ", ip, " (sample: ", shown("ok"), ")"),
        found("http_flood", n("all") >= 500, last("all"), "rate", True, n("all"), " requests from ", ip, " in batch (target: ", shown("all"), ")"),
        found("rate_limiting_bypass_after_429", (n("all") >= 60) & (n("s429") >= 3) & (n("other") >= 60), last("all"), "http_status", True, n("all"), " requests with ", n("s429"), " HTTP 429 responses from ", ip, " (target: ", shown("all"), ")"),
        found("slowloris_suspected", net.is_global(ip) & (F.col("paths") >= 100), last("all"), "uri_path", True, "Slowloris suspected: ", F.col("paths"), " unique URIs hit from public IP ", ip),
        found("api_rate_abuse", F.col("api").isNotNull(), F.col("api.last"), "uri_path", True, "API rate abuse from ", ip, " targeting ", F.col("api.api"), " (", F.col("api.n"), " requests)"),
        found("resource_exhaustion", n("costly") >= 30, last("costly"), "uri_path", True, n("costly"), " expensive endpoint hits from ", ip, " (last: ", shown("costly"), ")"),
    ]
    return by_source.select(*keys, "src_ip", F.inline(F.array_compact(F.array(*rules))))


def describe(found: DataFrame) -> DataFrame:
    """Adds category, family, severity, confidence and description of each row's rule."""
    def of(what: str) -> Column:
        pairs = ", ".join(f"{_quoted(r.name)}, {_quoted(v) if isinstance(v := getattr(r, what), str) else f'{v!r}D'}" for r in EVERY.values())
        return F.expr(f"element_at(map({pairs}), rule_name)")

    return found.withColumns({k: of(k) for k in ("category", "family", "severity", "confidence", "description")})
