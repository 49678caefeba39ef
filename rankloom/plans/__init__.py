"""Complete plans: rankings, the derived candidates table, the registered queries."""
