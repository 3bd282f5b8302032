"""sparkloom: data-science analytics operators written for Apache Spark."""
