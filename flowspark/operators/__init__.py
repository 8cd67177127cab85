"""DataFrame operators over packets, flows and stores."""
