"""Fixed dictionaries: statistic groups, idle events, functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statistics that measure time.
TIME = (
    "db time",
    "cpu used by this session",
    "recursive cpu usage",
    "user i/o wait time",
    "concurrency wait time",
    "application wait time",
    "cluster wait time",
    "scheduler wait time",
    "non-idle wait time",
    "parse time elapsed",
    "parse time cpu",
    "hard parse elapsed time",
    "redo write time",
    "redo write total time",
    "redo log space wait time",
    "redo synch time",
    "redo synch time (usec)",
    "file io service time",
    "file io wait time",
    "effective io time",
    "session connect time",
    "process last non-idle time",
    "in call idle wait time",
    "db time of lwts for this session",
)

# Statistics that measure volume.
VOLUME = (
    "bytes sent via sql*net to client",
    "bytes received via sql*net from client",
    "bytes sent via sql*net to dblink",
    "bytes received via sql*net from dblink",
    "logical read bytes from cache",
    "physical read bytes",
    "physical read total bytes",
    "physical read total bytes optimized",
    "physical write bytes",
    "physical write total bytes",
    "physical write total bytes optimized",
    "redo size",
    "redo size for direct writes",
    "undo change vector size",
    "temp space allocated (bytes)",
    "flashback log write bytes",
    "cell physical io interconnect bytes",
    "cell physical io interconnect bytes returned by smart scan",
    "cell physical io bytes eligible for predicate offload",
    "cell physical io bytes eligible for smart ios",
    "cell physical io bytes saved by storage index",
    "cell physical io bytes saved by columnar cache",
)

# Statistics that count.
COUNTERS = (
    "logons cumulative",
    "logons current",
    "user logons cumulative",
    "user logouts cumulative",
    "opened cursors cumulative",
    "opened cursors current",
    "pinned cursors current",
    "session cursor cache hits",
    "cursor reload failures",
    "parse count (total)",
    "parse count (hard)",
    "parse count (failures)",
    "execute count",
    "user calls",
    "recursive calls",
    "user commits",
    "user rollbacks",
    "transaction rollbacks",
    "session logical reads",
    "db block gets",
    "db block gets from cache",
    "db block gets direct",
    "consistent gets",
    "consistent gets from cache",
    "consistent gets direct",
    "db block changes",
    "consistent changes",
    "cr blocks created",
    "physical reads",
    "physical reads cache",
    "physical reads cache prefetch",
    "physical reads direct",
    "physical reads direct (lob)",
    "physical reads direct temporary tablespace",
    "physical read io requests",
    "physical read total io requests",
    "physical read total multi block requests",
    "physical read requests optimized",
    "physical writes",
    "physical writes from cache",
    "physical writes direct",
    "physical writes direct (lob)",
    "physical writes direct temporary tablespace",
    "physical write io requests",
    "physical write total io requests",
    "physical write total multi block requests",
    "physical write requests optimized",
    "physical writes non checkpoint",
    "free buffer requested",
    "free buffer inspected",
    "dirty buffers inspected",
    "pinned buffers inspected",
    "hot buffers moved to head of lru",
    "dbwr checkpoint buffers written",
    "dbwr checkpoints",
    "dbwr lru scans",
    "background checkpoints started",
    "background checkpoints completed",
    "redo entries",
    "redo buffer allocation retries",
    "redo writes",
    "redo blocks written",
    "redo log space requests",
    "redo synch writes",
    "redo synch polls",
    "redo synch poll writes",
    "flashback log writes",
    "sorts (memory)",
    "sorts (disk)",
    "sorts (rows)",
    "workarea executions - optimal",
    "workarea executions - onepass",
    "workarea executions - multipass",
    "enqueue requests",
    "enqueue releases",
    "enqueue waits",
    "enqueue timeouts",
    "enqueue deadlocks",
    "enqueue conversions",
    "table scans (short tables)",
    "table scans (long tables)",
    "table scans (direct read)",
    "table fetch by rowid",
    "table fetch continued row",
    "index range scans",
    "index fast full scans (full)",
    "index fast full scans (direct read)",
    "index fetch by key",
    "leaf node splits",
    "branch node splits",
    "sql*net roundtrips to/from client",
    "sql*net roundtrips to/from dblink",
    "gc cr blocks served",
    "gc cr blocks received",
    "gc cr blocks flushed",
    "gc cr blocks built",
    "gc current blocks served",
    "gc current blocks received",
    "gc current blocks flushed",
    "gc current blocks pinned",
    "gc read waits",
    "cell flash cache read hits",
    "physical read flash cache hits",
    "cell ram cache read hits",
)

# Statistics that go with CPU use.
CPU = (
    "cpu used by this session",
    "cpu used when call started",
    "recursive cpu usage",
    "ipc cpu used by this session",
    "global enqueue cpu used by this session",
    "cpu used by lwts for this session",
    "user calls",
    "execute count",
    "recursive calls",
    "recursive system api invocations",
    "user logons cumulative",
    "user logouts cumulative",
    "parse count (total)",
    "parse count (hard)",
    "parse count (failures)",
    "parse time cpu",
    "session logical reads",
    "db block gets",
    "db block gets from cache",
    "db block gets direct",
    "consistent gets",
    "consistent gets from cache",
    "consistent gets direct",
    "consistent gets pin",
    "consistent gets examination",
    "cr blocks created",
    "free buffer inspected",
    "dirty buffers inspected",
    "pinned buffers inspected",
    "hot buffers moved to head of lru",
    "db block changes",
    "consistent changes",
    "sorts (memory)",
    "sorts (rows)",
    "workarea executions - optimal",
    "workarea executions - onepass",
    "table fetch by rowid",
    "table fetch continued row",
    "index fetch by key",
    "index range scans",
    "index fast full scans (full)",
    "plsql execution elapsed time",
    "plsql compilation elapsed time",
    "opened cursors cumulative",
    "opened cursors current",
    "session cursor cache hits",
    "cursor reload failures",
)

# Wait events that are idle.
IDLE = (
    "cached session",
    "VKTM Logical Idle Wait",
    "VKTM Init Wait for GSGA",
    "IORM Scheduler Slave Idle Wait",
    "rdbms ipc message",
    "i/o slave wait",
    "OFS Receive Queue",
    "OFS idle",
    "Generic Process Pool Dispatcher: idle",
    "Generic Process Pool Worker: sleep",
    "VKRM Idle",
    "wait for unread message on broadcast channel",
    "wait for unread message on multiple broadcast channels",
    "class slave wait",
    "idle class spare wait event 1",
    "idle class spare wait event 2",
    "idle class spare wait event 3",
    "idle class spare wait event 4",
    "idle class spare wait event 5",
    "idle class spare wait event 6",
    "idle class spare wait event 7",
    "idle class spare wait event 8",
    "idle class spare wait event 9",
    "idle class spare wait event 10",
    "RMA: IPC0 completion sync",
    "PING",
    "spawn request deferred",
    "watchdog main loop",
    "process in prespawned state",
    "pmon timer",
    "pman timer",
    "DNFS disp IO slave idle",
    "NVM disp IO slave idle",
    "BRDG: bridge controller idle",
    "Network Retrans by Server",
    "Network Retrans by Client",
    "Distributed Trace: Archival Worker Idle",
    "DIAG idle wait",
    "ges remote message",
    "SCM slave idle",
    "LMS CR slave timer",
    "gcs remote message",
    "gcs yield cpu",
    "heartbeat monitor sleep",
    "GCR sleep",
    "Shutdown completion due to error",
    "SGA: MMAN sleep for component shrink",
    "DBWR timer",
    "Data Guard: Gap Manager",
    "Data Guard: controlfile update",
    "MRP redo arrival",
    "Data Guard: Timer",
    "LNS ASYNC archive log",
    "LNS ASYNC dest activation",
    "LNS ASYNC end of log",
    "Archiver: redo logs",
    "simulated log write delay",
    "heartbeat redo informer",
    "LGWR real time apply sync",
    "LGWR worker group idle",
    "parallel recovery slave idle wait",
    "Backup Appliance waiting for work",
    "Backup Appliance waiting restore start",
    "Backup Appliance Surrogate wait",
    "Backup Appliance Servlet wait",
    "Backup Appliance Comm SGA setup wait",
    "LogMiner builder: idle",
    "LogMiner builder: branch",
    "LogMiner preparer: idle",
    "LogMiner reader: log (idle)",
    "LogMiner reader: redo (idle)",
    "LogMiner merger: idle",
    "LogMiner client: transaction",
    "LogMiner: other",
    "LogMiner: activate",
    "LogMiner: reset",
    "LogMiner: find session",
    "LogMiner: internal",
    "Logical Standby Apply Delay",
    "parallel recovery coordinator waits for slave cleanup",
    "parallel recovery coordinator idle wait",
    "parallel recovery control message reply",
    "parallel recovery slave next change",
    "nologging fetch slave idle",
    "recovery sender idle",
    "recovery receiver idle",
    "recovery coordinator idle",
    "recovery logmerger idle",
    "block compare coord process idle",
    "Data Guard PDB query SCN service idle",
    "True Cache: background process idle",
    "PX Deq: Txn Recovery Start",
    "PX Deq: Txn Recovery Reply",
    "fbar timer",
    "smon timer",
    "PX Deq: Metadata Update",
    "Space Manager: slave idle wait",
    "PX Deq: Index Merge Reply",
    "PX Deq: Index Merge Execute",
    "PX Deq: Index Merge Close",
    "PX Deq: kdcph_mai",
    "PX Deq: kdcphc_ack",
    "imco timer",
    "IMFS defer writes scheduler",
    "memoptimize write drain idle",
    "MLE sleep",
    "virtual circuit next request",
    "shared server idle wait",
    "dispatcher timer",
    "cmon timer",
    "pool server timer",
    "lreg timer",
    "JOX Jit Process Sleep",
    "jobq slave wait",
    "pipe get",
    "PX Deque wait",
    "PX Idle Wait",
    "PX Deq Credit: need buffer",
    "PX Deq Credit: send blkd",
    "PX Deq: Msg Fragment",
    "PX Deq: Parse Reply",
    "PX Deq: Execute Reply",
    "PX Deq: Execution Msg",
    "PX Deq: Table Q Normal",
    "PX Deq: Table Q Sample",
    "REPL Apply: txns",
    "REPL Capture/Apply: messages",
    "REPL Capture: archive log",
    "single-task message",
    "SQL*Net message from client",
    "SQL*Net vector message from client",
    "SQL*Net vector message from dblink",
    "PL/SQL lock timer",
    "Streams AQ: emn coordinator idle wait",
    "EMON slave idle wait",
    "Emon coordinator main loop",
    "Emon slave main loop",
    "Streams AQ: waiting for messages in the queue",
    "Streams AQ: waiting for time management or cleanup tasks",
    "Streams AQ: delete acknowledged messages",
    "Streams AQ: deallocate messages from Streams Pool",
    "Streams AQ: qmn coordinator idle wait",
    "Streams AQ: qmn slave idle wait",
    "AQ: 12c message cache init wait",
    "AQ Cross Master idle",
    "AQPC idle",
    "Streams AQ: load balancer idle",
    "Sharded  Queues : Part Maintenance idle",
    "Sharded  Queues : Part Truncate idle",
    "REPL Capture/Apply: RAC AQ qmn coordinator",
    "Streams AQ: opt idle",
    "HS message to agent",
    "ASM background timer",
    "ASM cluster membership changes",
    "AUTO access ASM_CLIENT registration",
    "iowp msg",
    "iowp file id",
    "netp network",
    "gopp msg",
    "auto-sqltune: wait graph update",
    "WCR: replay client notify",
    "WCR: replay clock",
    "WCR: replay paused",
    "JS external job",
    "cell worker idle",
    "Multi-Tenant Redo File Server - Flush Header Interval",
    "Sharding replication",
    "Consensus service idle",
    "Blockchain apply clean",
    "blockchain apply short",
    "blockchain apply long",
    "Blockchain reader process idle",
)

# IO functions.
IO_FUNCTIONS = (
    "RMAN",
    "DBWR",
    "LGWR",
    "ARCH",
    "XDB",
    "Streams AQ",
    "Data Pump",
    "Recovery",
    "Buffer Cache Reads",
    "Direct Reads",
    "Direct Writes",
    "Smart Scan",
    "Archive Manager",
    "Others",
)

# Descriptions of error numbers.
ORA_TEXT = {
    904: "invalid identifier",
    942: "table or view does not exist",
    6550: "PL/SQL compilation error",
    1722: "invalid number",
    1403: "no data found",
    1008: "not all variables bound",
    1036: "illegal variable name/number",
}
GROUPS = {"time": TIME, "volume": VOLUME, "counters": COUNTERS, "cpu": CPU}


def stat_groups(spark: SparkSession) -> DataFrame:
    """``stat_group, name`` of all statistics with a group; some names are in two."""
    return spark.createDataFrame([(g, n) for g, names in GROUPS.items() for n in names], "stat_group string, name string")


def of_group(stats: DataFrame, group: str, column: str = "name") -> DataFrame:
    """Statistics of a group, by their trimmed lower-case name."""
    return stats.where(F.lower(F.trim(F.col(column))).isin(*GROUPS[group]))


def is_idle(event: str | Column) -> Column:
    """Whether an event, whole or cut off, begins an idle event's name; so does the empty name.

    All beginnings of the idle names are few thousand, so that a hash set decides without comparing with each name.
    """
    beginnings = sorted({n[:k] for n in IDLE for k in range(len(n) + 1)})
    return (F.col(event) if isinstance(event, str) else event).isin(beginnings)
