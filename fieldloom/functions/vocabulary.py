"""Fixed values of field matching: word lists, type tables, patterns. Results depend on each of them."""

# --- fixed values: what a token stands for -------------------------------------------------------------------------
TOKEN_ALIAS = {
    "src": "source ip", "dst": "destination ip", "sip": "source ip", "dip": "destination ip",
    "sourceip": "source ip", "destip": "destination ip", "destinationip": "destination ip",
    "spt": "source port", "dpt": "destination port", "sport": "source port", "dport": "destination port",
    "sourceport": "source port", "destport": "destination port", "destinationport": "destination port",
    "saddr": "source address", "daddr": "destination address",
    "smac": "source mac", "dmac": "destination mac", "srcmac": "source mac", "dstmac": "destination mac",
    "usr": "user", "uid": "user id", "sess": "session", "sessid": "session id", "sessionid": "session id",
    "ts": "timestamp", "msg": "message", "proto": "protocol", "svc": "service", "svcid": "service id",
    "appid": "application id", "ruleid": "rule id", "policyid": "policy id", "country": "country", "cc": "country code",
    "srcip": "source ip", "dstip": "destination ip", "srcipcc": "source ip country code",
    "sipcc": "source ip country code", "dipcc": "destination ip country code",
    "natsrc": "source nat ip", "natdst": "destination nat ip", "natsport": "source nat port", "natdport": "destination nat port",
    "profileid": "profile id", "module_name": "module name", "moduleflag": "module flag",
    "ap_protocol": "application protocol", "descrption": "description",
}

SUFFIXES = ("ip", "port", "id", "name", "code", "time", "mac")

SYNONYMS = {
    "dest": "destination", "remote": "destination", "target": "destination", "origin": "source", "client": "source",
    "server": "destination", "usr": "user", "msg": "message", "proto": "protocol", "svc": "service",
}

#: Short forms that a full word adds, in order.
SHORT_FORMS = {
    "source": "sou src", "destination": "des dst dest", "session": "ses sess", "protocol": "pro proto",
    "message": "mes msg", "address": "add", "service": "svc", "user": "usr",
}

KOREAN = {
    "출발지": "source", "목적지": "destination", "원본": "source", "원격지": "destination", "클라이언트": "client",
    "서버": "server", "주소": "address", "아이피": "ip", "ip주소": "ip address", "포트": "port", "프로토콜": "protocol",
    "세션": "session", "시간": "time", "시각": "time", "시작": "start", "종료": "end", "이름": "name", "사용자": "user",
    "모듈": "module", "설명": "description", "행위": "action", "동작": "action", "국가": "country", "코드": "code",
    "서비스": "service", "버전": "version", "메시지": "message", "로그": "log", "규칙": "rule", "정책": "policy",
    "응답": "response", "요청": "request", "탐지": "detect", "공격": "attack", "위험": "threat", "백신": "antivirus",
    "방화벽": "firewall", "웹방화벽": "waf", "아이디": "id",
    "로그인": "login", "방식": "method", "전달가능": "forwardable", "인증": "authentication",
    "인증티켓": "authentication ticket", "여부": "is", "서비스명": "service name", "외부": "external",
    "거래": "transaction", "네트워크": "network", "속도": "speed", "호스트명": "host name", "호스트": "host",
    "프로세스": "process", "부모": "parent", "시스템": "system", "대상": "target", "사용자명": "username",
    "계정": "account", "장비": "device", "도메인": "domain", "참여": "joined", "파일명": "filename", "파일": "file",
    "이벤트": "event", "스레드": "thread", "레코드": "record", "유형": "type", "타입": "type", "한정자": "qualifier",
    "레지스트리": "registry", "키": "key", "악성": "malicious", "운영체제": "operating system",
    "아키텍처": "architecture", "경과시간": "elapsed time", "초": "sec", "대화형": "interactive", "명령어": "command",
    "오류": "error", "심각도": "severity", "본문": "body", "접속": "connection", "권한": "privilege", "상승": "escalation",
    "길이": "length", "용량": "capacity", "상태": "status", "명": "name", "공격자": "attacker", "위협": "threat",
}

COMPACT_SPLITS = {
    "srcip": "source ip", "sourceip": "source ip", "sip": "source ip", "dstip": "destination ip",
    "destip": "destination ip", "destinationip": "destination ip", "dip": "destination ip",
    "srcport": "source port", "sport": "source port", "dstport": "destination port", "dport": "destination port",
    "eventid": "event id", "ruleid": "rule id", "policyid": "policy id", "userid": "user id", "username": "user name",
    "hostname": "host name", "filepath": "file path", "filename": "file name", "filetype": "file type",
    "macaddr": "mac address", "macaddress": "mac address", "ipaddr": "ip address", "ipaddress": "ip address",
}

# --- fixed values: types ------------------------------------------------------------------------------------------
TYPE_GROUPS = {
    "ip": "ip ipaddr ipaddress ipv4 ipv6",
    "port": "port",
    "integer": "integer int long short number numeric bigint smallint",
    "float": "float double decimal real",
    "datetime": "datetime timestamp time date",
    "boolean": "bool boolean",
    "string": "string str text keyword varchar char",
    "array": "array list",
    "object": "object dict json map",
}

#: Compatibility of two types where it is not zero; pairs hold both ways. A: plain types, B: canonical types.
TYPE_COMPAT_A = {("ip", "ip"): 1.0, ("port", "port"): 1.0, ("integer", "integer"): 1.0, ("string", "string"): 1.0, ("datetime", "datetime"): 1.0, ("integer", "port"): 0.6, ("string", "datetime"): 0.2}
TYPE_COMPAT_B = {(t, t): 1.0 for t in TYPE_GROUPS} | {
    ("integer", "port"): 0.8,
    ("integer", "float"): 0.65,
    ("string", "datetime"): 0.35,
    ("string", "ip"): 0.30,
    ("string", "port"): 0.25,
    ("string", "boolean"): 0.20,
}

TYPE_DRIFT = {"ip": "string", "port": "integer", "integer": "string", "float": "integer", "datetime": "string", "boolean": "string", "string": "datetime"}

# --- fixed values: polarity, slots, placeholders ------------------------------------------------------------------
SOURCE_WORDS = "source src client origin sender attacker".split()
DESTINATION_WORDS = "destination dst dest target server victim receiver".split()

SLOT_PATTERNS = {
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PORT": r"(?::|\b)(?:[1-9][0-9]{0,4})\b",
    "TIME": r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?\b",
    "URL": r"(?i)\bhttps?://[^\s]+",
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "MAC": r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b",
    "HASH": r"(?i)\b[a-f0-9]{32,128}\b",
    "DOMAIN": r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b",
}

SLOT_WORDS = {
    "IP": "ip address", "PORT": "port", "TIME": "time timestamp date", "URL": "url uri", "DOMAIN": "domain dns",
    "EMAIL": "email", "MAC": "mac", "HASH": "hash md5 sha1 sha256", "USER": "user account", "HOST": "host hostname",
    "EVENT": "event attack", "ACTION": "action", "POLICY": "policy rule", "STATUS": "status result",
}

IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PORT_PATTERN = r":\d{1,5}\b"
TIME_PATTERN = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"

# --- fixed values: training views ---------------------------------------------------------------------------------
ALIAS_GROUPS = [
    "source src client origin",
    "destination dst dest server target",
    "user usr account",
    "session sess",
    "protocol proto",
    "message msg",
    "service svc",
    "address addr",
]

PROTECTED_WORDS = "ip id bps pps rx tx tcp udp icmp nat dnat snat vpn ssl dns fw cpu mem rtt pkt pkts".split()
