"""Files and protocols as tables: COPY from and to, line protocol, samples, logs, webhooks."""
