"""Rules for common attacks, as sequences of an endpoint's events by process.

They work on broad event types (``process``, ``file``, ``network``) of ``pack_schema``; ``broad_types`` gives these to events of the
host's finer types. Each is meant as a start: programs, ports and paths are parameters of the functions that write them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.plans import ir
from emberline.plans.parser import parse
from emberline.schema import Schema, host_schema

BROAD = {"process": ("process_exec", "process_exit"), "file": ("file_create", "file_rename", "file_unlink", "file_write", "file_read"), "network": ("network_connect", "network_send")}
DOCUMENTS = ("docx", "doc", "xlsx", "xls", "pptx", "ppt", "pdf", "jpeg", "jpg", "png")
RANSOM = ("locked", "encrypted", "crypted", "crypto", "ransom", "vault")
ARCHIVERS = ("7z", "7za", "gzip", "tar", "zip")
CLOUDS = ("dropbox", r"s3\\.amazonaws", r"drive\\.google", r"blob\\.core\\.windows")
SHELLS = ("/bin/zsh", "/bin/sh", "/bin/bash")


def pack_schema() -> Schema:
    """The host's fields under three broad event types."""
    host = host_schema()
    out = Schema(fields=host.fields, aliases=host.aliases)
    for t in BROAD:
        out.add_type(t)
    return out


def broad_types(events: DataFrame, type_col: str = "event_type") -> DataFrame:
    """``events`` with the broad type of each; others keep theirs."""
    out: Column = F.col(type_col)
    for broad, fine in BROAD.items():
        out = F.when(F.col(type_col).isin(*fine), broad).otherwise(out)
    return events.withColumn(type_col, out)


def _any(words: Sequence) -> str:
    return "(" + ", ".join(str(w) if isinstance(w, int) else f'"{w}"' for w in words) + ")"


def _by_process(rule_id: str, severity: str, span: str, *steps: str) -> ir.Rule:
    return parse(f"sequence by process.entity_id {' '.join(f'[{s}]' for s in steps)} with maxspan={span}").named(rule_id, severity=severity)


def ransomware(documents: Sequence[str] = DOCUMENTS, endings: Sequence[str] = RANSOM) -> ir.Rule:
    """A document is touched, then a file with an extortionist's ending by the same process."""
    return _by_process("ransomware", "critical", "5s", rf'file where file.path regex~ "\\.({"|".join(documents)})$"', rf'file where file.name regex~ "\\.({"|".join(endings)})$"')


def exfiltration(archivers: Sequence[str] = ARCHIVERS, hosts: Sequence[str] = CLOUDS, ports: Sequence[int] = (80, 443)) -> ir.Rule:
    """Documents or databases are archived, then sent out."""
    packs = rf'process where process.executable in {_any(archivers)} and process.args regex~ "\\.(pdf|doc|db|sql)"'
    sends = f'network where (network.dest_port in {_any(ports)} or network.dest_host regex~ "{"|".join(hosts)}") and network.direction == "outbound"'
    return _by_process("data_exfiltration", "high", "5m", packs, sends)


def lateral_movement(tools: Sequence[str] = ("/usr/bin/rsync", "/usr/bin/scp", "/usr/bin/ssh"), port: int = 22) -> ir.Rule:
    """A remote tool starts with somebody's address, then connects."""
    return _by_process("lateral_movement", "high", "60s", f'process where process.args contains "@" and process.executable in {_any(tools)}', f"network where network.dest_port == {port}")


def privilege_escalation(tools: Sequence[str] = ("/bin/su", "/usr/bin/sudo"), paths: Sequence[str] = ("/etc/passwd", "/etc/shadow", "/etc/sudoers")) -> ir.Rule:
    """A tool that changes the user, then a file that says who may."""
    return _by_process("privilege_escalation", "high", "30s", f"process where process.executable in {_any(tools)}", f"file where file.path in {_any(paths)}")


def reverse_shell(ports: Sequence[int] = (4444, 5555, 1024, 65535), shells: Sequence[str] = SHELLS) -> ir.Rule:
    """A connection to an odd port, then a shell."""
    return _by_process("reverse_shell", "critical", "10s", f'network where network.dest_port in {_any(ports)} and network.direction == "outbound"', f"process where process.executable in {_any(shells)}")


def credential_access(keys: Sequence[str] = ("rsa", "dsa", "ecdsa", "ed25519"), tools: Sequence[str] = ("hashcat", "john", "fcrackzip", "mimikatz", "mimipenguin")) -> ir.Rule:
    """A process that holds a credential file, or a tool that breaks them."""
    files = _any(["/etc/master.passwd", "/etc/shadow", *(f"/root/.ssh/id_{k}" for k in keys)])
    text = rf'process where process.executable in {_any(tools)} or file.path in {files} or file.path regex~ "\\.ssh/|Login Data|logins\\.json"'
    return parse(text).named("credential_access", severity="high")


def all_packs() -> list[ir.Rule]:
    return [replace(r, tags=("pack",)) for r in (ransomware(), exfiltration(), lateral_movement(), privilege_escalation(), reverse_shell(), credential_access())]
