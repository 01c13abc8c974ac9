"""Where rows come from: tables, workloads and traces."""
