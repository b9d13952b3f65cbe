"""All registered queries and, where SQL can state them, their oracles."""

from quayline.plans import change_queries as _changes
from quayline.plans import delivery_queries as _deliveries
from quayline.plans import event_queries as _events
from quayline.plans import file_queries as _files
from quayline.plans import log_queries as _logs
from quayline.plans import stream_queries as _streams
from quayline.plans import table_queries as _tables

_MODULES = (_files, _events, _deliveries, _logs, _tables, _changes, _streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

# A stream must leave the same rows behind as the batch that does its work.
ORACLES["stream_cdc"] = _changes.ORACLES["cdc_current"]
ORACLES["stream_cdc_log"] = _changes.ORACLES["cdc_append"].replace("event_type, props", "props")
ORACLES["stream_delivery"] = _deliveries.ORACLES["route_counts"]
ORACLES["stream_backup"] = _deliveries.JUDGED + """
    SELECT CAST(status AS BIGINT) AS status, CASE status WHEN 405 THEN 'method not allowed' WHEN 404 THEN '404 page not found'
           WHEN 403 THEN 'invalid access key' WHEN 400 THEN 'invalid JSON body' WHEN 500 THEN 'base64 decode' END AS error,
           count(*) AS requests
    FROM judged WHERE status <> 200 GROUP BY status"""
