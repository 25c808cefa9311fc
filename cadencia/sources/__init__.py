"""Where rows come from: the driver's tables bridged to the domain, provider payloads, and synthetic athletes."""
