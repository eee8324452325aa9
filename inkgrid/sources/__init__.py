"""Images, dictionaries and other inputs."""
