"""Behavioural detectors: counters and sliding windows per process, as window functions.

Each takes host events (``schema.host_schema``) and gives the events at which it fires: ``pid, ts, event_id, reason``. Events of a process are taken in order
of time, then id; events without a process id are passed over. A ``reason`` is null where only the count so far
made the detector fire.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000
_TARGETS = "db doc docx jpeg jpg mdb mp3 mp4 pdf png ppt pptx rar sql txt xls xlsx zip"
_LOCKED = "crypt crypted crypto enc encrypted locked locked3 ransom vault"
_SHELLS = "bash csh dash ksh sh tcsh zsh"
_ARCHIVERS = "7z 7za bzip2 dd gzip lzma rar tar unzip xz zip"
_DUMPERS = "bcp mongodump mysqldump pg_dump pg_dumpall redis-cli sqlcmd sqlite3"
_UPLOADERS = "aws az curl dropbox ftp gcloud lftp mc ncftp rclone rsync scp sftp wget"
_CLOUDS = "1drv.com blob.core.windows.net box.com docs.google.com drive.google.com dropbox.com dropboxapi.com ghostbin.com icloud.com mega.co.nz mega.nz onedrive.live.com pastebin.com s3. storage.googleapis.com termbin.com"
_SECRETS = ".db .mdb .sql archive backup credential key passwd password secret token"
_REMOTE = "ansible ansible-playbook chef-client cssh fabric mount mount.cifs mount.nfs mussh pdsh pssh puppet rdesktop remmina rpcclient rsync salt salt-call scp sftp smbclient ssh vncviewer xfreerdp"
_LATERAL_PORTS = (23, 135, 139, 445, 3389, 5900, 5901, 5902, 5985, 5986)
_LATERAL_SERVICES = "nfsd nmbd rpcbind smbd sshd telnetd"
_USUAL_SUID = ("/bin/su", "/usr/bin/chsh", "/usr/bin/passwd", "/usr/bin/pkexec", "/usr/bin/sudo")
_GUARDED = {
    "shadow_access": ("/etc/shadow",),
    "root_ssh_access": ("/root/.ssh/",),
    "security_modify": ("/etc/security/",),
    "pam_modify": ("/etc/pam.d/",),
    "cron_modify": ("/var/spool/cron/", "/etc/cron.hourly/", "/etc/cron.daily/", "/etc/cron.d/", "/etc/crontab"),
    "sudoers_modify": ("/etc/sudoers",),
    "passwd_modify": ("/etc/passwd",),
    "group_modify": ("/etc/group",),
    "gshadow_access": ("/etc/gshadow",),
}
_CREDENTIALS = ".aws/credentials .azure/ .config/chromium/ .config/google-chrome/ .docker/config.json .kube/config .mozilla/firefox/ .my.cnf .netrc .ssh/authorized_keys .ssh/id_dsa .ssh/id_ecdsa .ssh/id_ed25519 .ssh/id_rsa .ssh/known_hosts /etc/krb5.keytab /etc/master.passwd /etc/passwd /etc/security/passwd /etc/ssh/sshd_config /etc/tcb/ /root/.ssh/ /tmp/krb5cc_ /var/lib/sss/db/ Cookies Login%Data Web%Data key3.db key4.db logins.json pgpass places.sqlite"
_CRACKERS = "browser-dump dumpcap hackbrowserdata hashcat john johntheripper linpeas linux-exploit-suggester mimikittenz pspy tcpdump tshark unshadow wireshark"
_KEYLOGGERS = "keylogger lkl logkeys"
_BACKCONNECT = (
    r"bash\s+-i",
    r"sh\s+-i",
    r"/dev/(?:tcp|udp)/",
    r"(?:nc|ncat)\s+-e\s+",
    r"nc\s+-c\s+",
    r"netcat.*exec",
    r"python.*(?:socket.*connect|subprocess.*call)",
    r"import\s+socket.*connect",
    r"pty\.spawn",
    r"perl\s+-(?:e.*socket|MIO::Socket)",
    r"ruby(?:\s+-rsocket|.*TCPSocket)",
    r"php(?:\s+-r.*sockopen|.*fsockopen)",
    r"powershell.*New-Object.*Net\.Sockets",
    r"mkfifo.*(?:tmp|backpipe)",
)
_SSH_TRICKS = (r"-i\s+.*id_(?:rsa|dsa|ecdsa|ed25519)", r"ssh\s+.*\s+%*?t?\s+[\w-]+\s+", r"ssh\s+.*['\"].*['\"]", r"-[LRD]\s+\d+", r"-A", r"-o\s+ForwardAgent")


def _words(text: str) -> list[str]:
    return [w.replace("%", " ") for w in text.split()]


def _escaped(texts: Iterable[str]) -> str:
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in texts)


def basename(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), "([^/]+)$", 1)


def named(path: Column, words: str) -> Column:
    """Whether a program is one of ``words``."""
    return F.coalesce(basename(path).isin(_words(words)), F.lit(False))


def has(text: Column, parts: Iterable[str]) -> Column:
    """Whether a text contains one of ``parts``."""
    return F.coalesce(text.rlike(_escaped(parts)), F.lit(False))


def ends(path: Column, extensions: str) -> Column:
    return F.coalesce(F.lower(path).rlike(r"\.(?:" + _escaped(_words(extensions)) + ")$"), F.lit(False))


def _is(*types: str) -> Column:
    return F.coalesce(F.col("event_type").isin(*types), F.lit(False))


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("process.pid").alias("pid"), F.col("ts_mono_ns").alias("ts"), *events.columns).where("pid is not null and ts is not null")


def _so_far() -> Window:
    """The events of the process up to the present one."""
    return Window.partitionBy("pid").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)


def _older(ns: int) -> Window:
    """Events of the process that are more than ``ns`` before the present one."""
    return Window.partitionBy("pid").orderBy("ts").rangeBetween(Window.unboundedPreceding, -ns - 1)


def _fired(df: DataFrame, fires: Column, reason: Column) -> DataFrame:
    return df.where(fires).select("pid", "ts", "event_id", reason.alias("reason"))


def _int(c: Column) -> Column:
    return c.cast("int")


def _cumulative(df: DataFrame, reason: Column, threshold: int, immediate: Iterable[str], weight: Column | None = None) -> DataFrame:
    """Fires when the events with a reason (or their weights) reach a number, at every event from there on; at once for some reasons."""
    df = df.withColumn("reason", reason)
    df = df.withColumn("points", F.coalesce(weight, F.lit(0)) if weight is not None else _int(F.col("reason").isNotNull()))
    df = df.withColumn("so_far", F.sum("points").over(_so_far()))
    at_once = F.coalesce(F.col("reason").isin(*immediate), F.lit(False)) if immediate else F.lit(False)
    return _fired(df, (F.col("so_far") >= threshold) | at_once, F.col("reason"))


def ransomware(events: DataFrame, renames: int = 10, window_ns: int = 5 * SECOND, touched: int = 20, operations: int = 15) -> DataFrame:
    """Many renames to the endings of locked files in a short time, or many valuable files touched amid many file operations."""
    path, new = F.col("file.path"), F.col("file.new_path")
    df = _events(events).where(_is("file_create", "file_rename", "file_write"))
    locked = _is("file_rename") & ends(new, _LOCKED)
    df = df.withColumn("locked", _int(locked)).withColumn("valued", _int((locked | _is("file_write")) & ends(path, _TARGETS)))
    old = _older(window_ns)
    recent = F.sum("locked").over(_so_far()) - F.coalesce(F.sum("locked").over(old), F.lit(0))
    ops = F.count(F.lit(1)).over(_so_far()) - F.count(F.lit(1)).over(old)
    df = df.withColumn("recent", recent).withColumn("ops", ops).withColumn("all_valued", F.sum("valued").over(_so_far()))
    many = F.col("recent") >= renames
    return _fired(df, many | ((F.col("all_valued") >= touched) & (F.col("ops") >= operations)), F.when(many, "mass_rename").otherwise("mass_access"))


def reverse_shell(events: DataFrame, window_ns: int = 10 * SECOND) -> DataFrame:
    """Command lines that connect a shell to a socket, shells whose parent had just connected, writes to ``/dev/tcp``."""
    df = _events(events)
    exe, args = F.col("process.executable"), F.col("process.command_line")
    command = F.concat(F.coalesce(exe, F.lit("")), F.lit(" "), F.coalesce(args, F.lit("")))
    direct = _fired(
        df,
        (_is("process_exec") & command.rlike("|".join(_BACKCONNECT))) | (_is("file_write") & has(F.col("file.path"), ["/dev/tcp/"])),
        F.when(_is("process_exec"), "command_line").otherwise("dev_tcp_write"),
    )
    # the parent's last connection before each shell: both in one ordered stream per process
    shells = df.where(_is("process_exec") & named(exe, _SHELLS) & ~command.rlike("|".join(_BACKCONNECT)) & F.col("process.ppid").isNotNull())
    rows = shells.select(F.col("process.ppid").alias("of"), "ts", "event_id", "pid", F.lit(None).cast("long").alias("connected")).unionByName(
        df.where(_is("network_connect", "network_send")).select(F.col("pid").alias("of"), "ts", "event_id", F.lit(None).cast("long").alias("pid"), F.col("ts").alias("connected"))
    )
    last = F.last("connected", ignorenulls=True).over(Window.partitionBy("of").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    spawned = rows.withColumn("last", last).where("pid is not null").where(F.col("ts") - F.col("last") <= window_ns)
    return direct.unionByName(spawned.select("pid", "ts", "event_id", F.lit("shell_of_network_parent").alias("reason")))


def exfiltration(events: DataFrame, window_ns: int = 300 * SECOND) -> DataFrame:
    """Archives or database dumps followed by uploads; fires from the first suspicious event of a process on."""
    exe, args, port = F.col("process.executable"), F.col("process.command_line"), F.col("network.dest_port")
    df = _events(events)
    run, connect = _is("process_exec"), _is("network_connect")
    df = df.withColumns({"archive": run & named(exe, _ARCHIVERS), "dump": run & named(exe, _DUMPERS), "upload": run & named(exe, _UPLOADERS)})
    cloud = connect & (has(F.lower("network.dest_host"), _words(_CLOUDS)) | has(F.lower("network.dest_ip"), _words(_CLOUDS)))
    df = df.withColumn("cloud", cloud)
    last = lambda flag: F.last(F.when(F.col(flag), F.col("ts")), ignorenulls=True).over(_so_far())
    df = df.withColumns({"archived": last("archive"), "dumped": last("dump")})
    before = F.col("archived").isNotNull() | F.col("dumped").isNotNull()
    recent = lambda c: F.coalesce(F.col("ts") - F.col(c) <= window_ns, F.lit(False))
    reason = (
        F.when(connect & F.coalesce(port.isin(4444, 5555, 6666, 9999), F.lit(False)) & before, "upload_to_odd_port")
        .when(F.col("cloud") & before, "data_to_cloud")
        .when(F.col("upload") & recent("dumped"), "dump_then_upload")
        .when(F.col("upload") & recent("archived"), "archive_then_upload")
        .when(F.col("dump"), "database_dump")
        .when(F.col("archive") & has(F.lower(args), _words(_SECRETS)), "archive_of_secrets")
    )
    df = df.withColumn("reason", reason)
    ever = lambda c: F.max(_int(c)).over(_so_far()) > 0
    df = df.withColumn("latched", ever(F.col("reason").isNotNull()) | (ever(F.col("archive")) & ever(F.col("cloud"))))
    return _fired(df, F.col("latched"), F.col("reason"))


def lateral_movement(events: DataFrame, threshold: int = 2, failures: int = 5) -> DataFrame:
    """Remote tools, ssh tricks, administration ports and services, logins from outside, repeated failed logins."""
    exe, args, port = F.col("process.executable"), F.col("process.command_line"), F.col("network.dest_port")
    result, ip = F.col("auth.result"), F.col("auth.src_ip")
    run = _is("process_exec")
    tool = run & named(exe, _REMOTE)
    trick = run & F.coalesce(F.lower(exe).contains("ssh"), F.lit(False)) & F.coalesce(args.rlike("|".join(_SSH_TRICKS)), F.lit(False))
    admin = _is("network_connect") & F.coalesce(port.isin(*_LATERAL_PORTS), F.lit(False))
    service = _is("service_start") & F.coalesce(F.lower("service.name").isin(_words(_LATERAL_SERVICES)), F.lit(False))
    login = _is("authentication") & F.coalesce(result == "success", F.lit(False)) & F.coalesce(~ip.rlike(r"^(?:127\.|192\.168\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"), F.lit(False))
    failed = _is("authentication") & F.coalesce(result == "failure", F.lit(False))
    df = _events(events).withColumn("failed", failed)
    df = df.withColumn("failed_so_far", F.sum(_int(F.col("failed"))).over(_so_far()))
    reason = (
        F.when(F.col("failed") & (F.col("failed_so_far") >= failures), "repeated_failures")
        .when(login, "outside_login")
        .when(service, "remote_service")
        .when(admin & (port == 23), "telnet")
        .when(admin, "admin_port")
        .when(trick, "ssh_options")
        .when(tool, "remote_tool")
    )
    return _cumulative(df, reason, threshold, ("telnet", "repeated_failures"), sum(map(_int, (tool, trick, admin, service, login)), F.lit(0)))


def privilege_escalation(events: DataFrame, threshold: int = 2) -> DataFrame:
    """Unusual set-uid programs, sudo tricks, root as effective user only, changes to guarded files."""
    exe, args, path = F.lower("process.executable"), F.col("process.command_line"), F.col("file.path")
    run = _is("process_exec")
    usual = F.coalesce(exe.isin(*_USUAL_SUID), F.lit(False))
    shell, odd = has(exe, ("bash", "sh", "zsh")) & ~usual, has(exe, ("find", "less", "man", "more", "nano", "nmap", "vim")) & ~usual
    sudo = run & F.coalesce(exe.contains("/usr/bin/sudo"), F.lit(False)) & args.isNotNull()
    changed = _is("file_create", "file_rename", "file_write")
    reason = F.when(F.lit(False), "")
    for name, parts in _GUARDED.items():
        reason = reason.when(changed & has(path, parts), name)
    reason = (
        reason.when(run & F.coalesce((F.col("process.uid") != F.col("process.euid")) & (F.col("process.euid") == 0), F.lit(False)), "root_as_effective_user")
        .when(sudo & has(args, ("-e", "EDITOR=")), "sudo_editor")
        .when(sudo & has(args, ("-u#-1", "-u#4294967295")), "sudo_bypass")
        .when(sudo & has(args, ("\\",)), "sudo_escape")
        .when(run & shell, "shell_suid")
        .when(run & odd, "unusual_suid")
    )
    return _cumulative(_events(events), reason, threshold, ("shadow_access", "sudo_bypass", "shell_suid"))


def credential_access(events: DataFrame, threshold: int = 2) -> DataFrame:
    """Tools that read credentials, files that hold them, other processes' memory, input devices."""
    exe, path = F.col("process.executable"), F.col("file.path")
    run, touched = _is("process_exec"), _is("file_create", "file_rename", "file_write", "file_read")
    memory = touched & has(path, ("/proc/", "/dev/kmem", "/dev/mem", "/dev/port"))
    foreign = memory & F.coalesce(path.rlike("/proc/[0-9]+/") & path.rlike("/maps|/mem") & ~path.contains("/proc/self/"), F.lit(False))
    reason = (
        F.when(touched & has(path, ("/dev/input/event", "/dev/input/kbd", "/dev/input/mice", "/dev/input/mouse")), "input_device")
        .when(foreign, "process_memory")
        .when(memory, "memory_access")
        .when(touched & has(path, ("/etc/shadow",)), "system_shadow")
        .when(touched & has(path, _words(_CREDENTIALS)), "credential_file")
        .when(run & named(exe, "mimipenguin"), "memory_dumper")
        .when(run & named(exe, _KEYLOGGERS), "keylogger")
        .when(run & named(exe, _CRACKERS), "credential_tool")
    )
    return _cumulative(_events(events), reason, threshold, ("system_shadow", "memory_dumper", "keylogger", "process_memory"))


DETECTORS = {f.__name__: f for f in (ransomware, reverse_shell, exfiltration, lateral_movement, privilege_escalation, credential_access)}
SEVERITIES = {"ransomware": "critical", "reverse_shell": "critical", "exfiltration": "high", "lateral_movement": "high", "privilege_escalation": "high", "credential_access": "high"}


def detect_all(events: DataFrame) -> DataFrame:
    """All detectors' findings, with ``rule_id`` and ``severity``."""
    out = None
    for name, f in DETECTORS.items():
        part = f(events).withColumns({"rule_id": F.lit(name), "severity": F.lit(SEVERITIES[name])})
        out = part if out is None else out.unionByName(part)
    return out
